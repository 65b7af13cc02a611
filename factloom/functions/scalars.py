"""Scalar functions as column expressions: unsigned comparison, lists, folding, names, paths and escapes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = (1 << 32) - 1


def u32(c: Column) -> Column:
    """An unsigned 32-bit operand; others are an error."""
    x = c.cast("long")
    return F.when(x.between(0, U32), x).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit("not an unsigned 32-bit value")).cast("long")))


def value_less(a: Column, b: Column) -> Column:
    return u32(a) < u32(b)


def value_less_equal(a: Column, b: Column) -> Column:
    return u32(a) <= u32(b)


def value_equal(a: Column, b: Column) -> Column:
    return u32(a) == u32(b)


def string_is_empty(s: Column) -> Column:
    return F.length(s) == 0


def list_create(*xs: Column) -> Column:
    return F.array(*xs)


def list_push(items: Column, x: Column) -> Column:
    """A new list; the old one is unchanged."""
    return F.array_append(items, x)


def split_strings(s: Column, token: str) -> Column:
    return F.split(s, re.escape(token), -1)


def valid_string(s: Column) -> Column:
    """No NUL inside."""
    return F.instr(s, "\0") == 0


def fold_unop(kind: str, a: Column) -> Column:
    x = a.cast("long")
    return {"coerce": x, "neg": -x, "bitwise_not": F.bitwise_not(x), "logical_not": (x == 0).cast("long")}[kind]


def _shift_left(x: Column, n: Column) -> Column:
    one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    power = one(F.least(n, F.lit(62))).cast("decimal(20,0)") * one(F.greatest(n - 62, F.lit(0))).cast("decimal(1,0)")
    return F.when(n.between(0, 64), (x.cast("decimal(19,0)") * power.cast("decimal(20,0)")).cast("decimal(38,0)")).otherwise(F.lit(0))


def _shift_right(x: Column, n: Column) -> Column:
    moved = F.call_function("shiftright", F.abs(x), n.cast("int"))
    return F.when(n.between(0, 62), F.when(x < 0, -moved).otherwise(moved)).otherwise(F.lit(0))


def fold_binop(kind: str, a: Column, b: Column) -> Column:
    """Constant folding: division rounds down and is 0 by 0; a remainder is 0 unless the divisor is positive; a shift by other
    than 0 to 64 is 0, and a right shift rounds towards 0."""
    x, y = a.cast("long"), b.cast("long")
    flag = lambda c: c.cast("long")
    table = {
        "plus": lambda: x + y, "minus": lambda: x - y, "mult": lambda: x * y,
        "div": lambda: F.when(y == 0, F.lit(0)).otherwise(_floor_div(x, y)),
        "mod": lambda: F.when(y > 0, F.pmod(x, y)).otherwise(F.lit(0)),
        "shift_left": lambda: _shift_left(x, y), "shift_right": lambda: _shift_right(x, y),
        "and": lambda: x.bitwiseAND(y), "or": lambda: x.bitwiseOR(y), "xor": lambda: x.bitwiseXOR(y),
        "min": lambda: F.least(x, y), "max": lambda: F.greatest(x, y),
        "less": lambda: flag(x < y), "less_equal": lambda: flag(x <= y), "greater": lambda: flag(x > y), "greater_equal": lambda: flag(x >= y),
        "equal": lambda: flag(x == y), "not_equal": lambda: flag(x != y),
        "logical_and": lambda: flag((x != 0) & (y != 0)), "logical_or": lambda: flag((x != 0) | (y != 0)),
    }
    return table[kind]()


def _floor_div(x: Column, y: Column) -> Column:
    """Exact in longs: the quotient less one where the signs differ and something is left."""
    rest = F.pmod(x, F.abs(y))
    exact = _int_div(x - rest, F.abs(y))
    return F.when(y > 0, exact).when(rest == 0, -exact).otherwise(-exact - 1)


def _int_div(x: Column, y: Column) -> Column:
    return (x.cast("decimal(20,0)") / y.cast("decimal(20,0)")).cast("decimal(20,0)").cast("long")


def wrap_integer(x: Column, bits: int, signed: bool) -> Column:
    """The value modulo 2**bits, in the type's range."""
    size = 1 << bits
    low = F.pmod(x.cast("decimal(38,0)"), F.lit(size).cast("decimal(38,0)"))
    return (F.when(low >= F.lit(size // 2).cast("decimal(38,0)"), low - F.lit(size).cast("decimal(38,0)")).otherwise(low) if signed else low).cast("decimal(38,0)")


def integer_range(bits: int, signed: bool) -> tuple[str, str]:
    """Least and greatest value of a type, as text."""
    return (str(-(1 << bits - 1)), str((1 << bits - 1) - 1)) if signed else ("0", str((1 << bits) - 1))


def html_escape(s: Column) -> Column:
    return F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_unescape(s: Column) -> Column:
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return s


def normalize_file(path: Column, base: str = "") -> Column:
    """A path relative to base, without ``.`` and ``..`` steps where these can be resolved; names in angle brackets stay."""
    below = F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path) if base else path
    rooted = F.startswith(below, F.lit("/"))
    steps = F.filter(F.split(below, "/"), lambda x: (x != "") & (x != "."))

    def walk(a: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))

    joined = F.concat_ws("/", F.aggregate(steps, F.array().cast("array<string>"), walk))
    return F.when(F.startswith(path, F.lit("<")), path).otherwise(F.when(rooted & F.lit(not base), F.concat(F.lit("/"), joined)).otherwise(joined))


def text_name_match(function: Column, name: Column) -> Column:
    """Whether a function's name, without a ``file:`` prefix, is the given one up to its arguments."""
    bare = F.regexp_replace(function, r"^[^:(]*[^:(]:(?!:)", "")
    return F.startswith(bare, name) & F.coalesce(F.substring(bare, F.length(name) + 1, F.lit(1)).isin("", "("), F.lit(False))


def trace_key(kind: Column, name: Column, field: Column) -> Column:
    """func:<function>, glob:<global> or comp:<type>[:<field>]."""
    return F.when(kind == "comp", F.concat_ws(":", kind, name, field)).otherwise(F.concat_ws(":", kind, name))


def assert_function(name: Column) -> Column:
    """The function in kind$file$function$loop$index; null where there are fewer parts."""
    parts = F.split(name, "\\$", -1)
    return F.when(F.size(parts) >= 4, parts.getItem(2))


#: What is taken off a report's name, one after the other, each at most once. In the fifth step the return
#: type ends at the first space, and begins after the last angle bracket before it.
_PRINTABLE = (
    (r"^[^$]*\$[^$]*\$", ""),  # kind and file
    (r"\$.*$", ""),  # loop and index
    (r"\([^!].*$", ""),  # argument types; (! belongs to a name
    (r"^static ", ""),
    (r"^virtual ", ""),
    (r"^const ", ""),
    (r"^((?:[^ ]*<)?)[^ <]* ", "$1"),
    (r"^[^:(]*:([^:])", "$1"),  # a file in front, but not a class
)


def report_printable(name: Column) -> Column:
    """The short form of a report's name kind$file$function$...: its function without file, arguments, qualifiers and return type."""
    for pattern, rest in _PRINTABLE:
        name = F.regexp_replace(name, pattern, rest)
    return name


def report_file(name: Column) -> Column:
    """A file name for a report: its short form in letters, digits and underscores, and the hash of the whole name."""
    return F.concat(F.regexp_replace(report_printable(name), "[^a-zA-Z0-9]", "_"), F.lit("_"), string_hash(name).cast("string"))


def directory_nesting(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def string_hash(s: Column) -> Column:
    """31 * h + byte over the UTF-8 bytes in signed 64-bit arithmetic, and the absolute value of that."""
    wide = lambda x: F.lit(str(x)).cast("decimal(38,0)")
    data = F.hex(F.encode(s, "UTF-8"))
    count = (F.length(data) / 2).cast("int")
    codes = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.conv(F.substring(data, 2 * i + 1, F.lit(2)), 16, 10).cast("decimal(38,0)"))).otherwise(F.array().cast("array<decimal(38,0)>"))
    step = lambda h, c: F.pmod((h * 31 + c).cast("decimal(38,0)"), wide(2**64)).cast("decimal(38,0)")
    h = F.aggregate(codes, wide(0), step)
    return F.when(h >= wide(2**63), wide(2**64) - h).otherwise(h).cast("decimal(20,0)")


_SUFFIX = r"[uUlL]*$"


def string_to_int(s: Column) -> Column:
    """C integer literals: decimal, hexadecimal, octal and characters, with suffixes; null for other text."""
    bare = F.regexp_replace(s, _SUFFIX, "")
    sign = F.when(F.startswith(bare, F.lit("-")), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(20,0)")
    digits = F.regexp_replace(bare, "^[+-]", "")
    number = F.when(digits.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.conv(F.substring(digits, 3, 16), 16, 10)).when(digits.rlike("^0[0-7]*$"), F.conv(digits, 8, 10)).when(digits.rlike("^[1-9][0-9]{0,18}$"), digits)
    return F.when(s.rlike("^'[^'\\\\]'$"), F.ascii(F.substring(s, 2, 1)).cast("decimal(20,0)")).otherwise((sign * number.cast("decimal(20,0)")).cast("decimal(20,0)"))


ESCAPES = {"n": 10, "t": 9, "r": 13, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34, "?": 63}


def unescape_literal(text: str) -> bytes | None:
    """The bytes of a C string literal between its quotes; None where an escape is malformed."""
    out, at = bytearray(), 0
    while at < len(text):
        if text[at] != "\\":
            out += text[at].encode()
            at += 1
            continue
        if m := re.compile(r"x([0-9a-fA-F]{1,2})").match(text, at + 1):
            out.append(int(m[1], 16))
        elif m := re.compile(r"[0-7]{1,3}").match(text, at + 1):
            out.append(int(m[0], 8) & 255)
        elif at + 1 < len(text) and text[at + 1] in ESCAPES:
            out.append(ESCAPES[text[at + 1]])
            at += 2
            continue
        else:
            return None
        at = m.end()
    return bytes(out)

"""A small plan builder: programs of assignments, calls, sequences, tests and loops over named operators.

Values are bound to variables: scalars, lists, or DataFrames. A program runs in order and stops at the first failing
action; what ran before stays done. Where a loop's body is the same for every element, bind the whole DataFrame and call a
set-based operator instead; ``Foreach`` is for lists on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame


class TransactionError(Exception):
    """An action failed; earlier ones keep their effects."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass
class Assign:
    target: str
    value: Any


@dataclass
class Call:
    function: str
    args: tuple = ()
    target: str | None = None


@dataclass
class Sequence:
    actions: list


@dataclass
class Test:
    condition: Any
    body: Any
    run_value: bool = True


@dataclass
class Foreach:
    target: str
    items: Any
    body: Any


@dataclass
class Transaction:
    """Variables that start with '$' are returned; others are temporary."""

    functions: dict[str, Callable]
    variables: dict[str, Any] = field(default_factory=dict)

    def value(self, operand: Any) -> Any:
        if isinstance(operand, Var):
            if operand.name not in self.variables:
                raise TransactionError(f"variable {operand.name} is not bound")
            return self.variables[operand.name]
        return [self.value(x) for x in operand] if isinstance(operand, list) else operand

    def run(self, action: Any) -> None:
        if isinstance(action, Assign):
            self.variables[action.target] = self.value(action.value)
        elif isinstance(action, Call):
            if action.function not in self.functions:
                raise TransactionError(f"no function {action.function}")
            result = self.functions[action.function](*(self.value(a) for a in action.args))
            if action.target is not None:
                if result is None:
                    raise TransactionError(f"{action.function} gave no result")
                self.variables[action.target] = result
        elif isinstance(action, Sequence):
            for x in action.actions:
                self.run(x)
        elif isinstance(action, Test):
            found = self.value(action.condition)
            if not isinstance(found, bool):
                raise TransactionError("a test needs a boolean")
            if found == action.run_value:
                self.run(action.body)
        elif isinstance(action, Foreach):
            items = self.value(action.items)
            if isinstance(items, DataFrame):
                raise TransactionError("bind the DataFrame whole and call a set-based operator")
            for x in items:
                self.variables[action.target] = x
                self.run(action.body)
        else:
            raise TransactionError(f"not an action: {action!r}")

    def returned(self) -> dict[str, Any]:
        return {k: v for k, v in self.variables.items() if k.startswith("$")}


def registry(multimaps, counters, extra: dict[str, Callable] | None = None) -> dict[str, Callable]:
    """The vocabulary of named operators over a session's multimaps and counters."""

    def check(x: Any, kind: type) -> Any:
        if not isinstance(x, kind) or (kind is int and (isinstance(x, bool) or not 0 <= x < 1 << 32)):
            raise TransactionError(f"{x!r} is not {kind.__name__}")
        return x

    found = {
        "value_less": lambda a, b: check(a, int) < check(b, int),
        "value_less_equal": lambda a, b: check(a, int) <= check(b, int),
        "value_equal": lambda a, b: check(a, int) == check(b, int),
        "string_is_empty": lambda s: check(s, str) == "",
        "list_create": lambda *xs: list(xs),
        "list_push": lambda items, x: [*check(items, list), x],
        "counter_inc": lambda n: counters.inc(n),
        "counter_dec": lambda n: counters.dec(n) or _fail("counter is at zero"),
        "counter_value": lambda n: counters.value(n),
        "hash_exists": lambda n: multimaps.exists(n),
        "hash_clear": lambda n: multimaps.clear(n),
        "hash_is_empty": lambda n: multimaps.is_empty(n),
        "hash_insert": lambda n, rows: multimaps.insert(n, rows),
        "hash_remove": lambda n, rows: multimaps.remove(n, rows),
        "hash_lookup": lambda n, asked: multimaps.lookup(n, asked),
        "hash_is_member": lambda n, asked: multimaps.is_member(n, asked),
        "hash_choose_key": lambda n: multimaps.choose_key(n),
        "hash_all_keys": lambda n: multimaps.all_keys(n),
    }
    return found | (extra or {})


def _fail(why: str):
    raise TransactionError(why)


def create_keys(name: str, keys: DataFrame) -> Sequence:
    """Where a multimap doesn't exist yet, create it with all keys of a store."""
    return Sequence([Call("hash_exists", (name,), "exists"), Test(Var("exists"), Call("hash_insert", (name, keys)), run_value=False)])


def run_if_empty(name: str, action: Any) -> Sequence:
    return Sequence([Call("hash_is_empty", (name,), "empty"), Test(Var("empty"), action)])


def clear_store_if_absent(name: str, clear: Any) -> Sequence:
    """Clear a store where the multimap does not exist."""
    return Sequence([Call("hash_exists", (name,), "exists"), Test(Var("exists"), clear, run_value=False)])


def pop_batch(worklist: DataFrame, store: DataFrame) -> DataFrame:
    """(key, value) of all waiting keys at once, the empty string where the store lacks a key."""
    from factloom.operators.store import lookup

    return lookup(store, worklist.select("key").distinct())

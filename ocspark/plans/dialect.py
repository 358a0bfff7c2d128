"""The few places where Spark SQL and the comparison engine's SQL differ."""

from __future__ import annotations


class Spark:
    """Spellings of Spark SQL."""

    name = "spark"

    @staticmethod
    def micros(ts: str) -> str:
        return f"unix_micros(cast({ts} as timestamp))"

    @staticmethod
    def json(column: str, key: str) -> str:
        return f"get_json_object({column}, '$.{key}')"

    @staticmethod
    def join(value: str, sep: str, *order: str) -> str:
        """Texts of a group joined in an order."""
        keys = ", ".join(f"{o} as k{i}" for i, o in enumerate(order))
        return f"array_join(transform(array_sort(collect_list(struct({keys}, {value} as v))), s -> s.v), '{sep}')"

    @staticmethod
    def latest(value: str, *order: str) -> str:
        """The value of the row that comes last in an order."""
        return f"max_by({value}, struct({', '.join(order)}))"

    @staticmethod
    def earliest(value: str, *order: str) -> str:
        return f"min_by({value}, struct({', '.join(order)}))"

    @staticmethod
    def join_distinct(value: str, sep: str) -> str:
        return f"array_join(array_sort(collect_set({value})), '{sep}')"

    @staticmethod
    def pick(names, quoted: bool = True) -> str:
        """The n-th of names, as texts or as columns."""
        return "case " + " ".join(f"when n = {i} then " + (f"'{k}'" if quoted else k) for i, k in enumerate(names)) + " end"

    @staticmethod
    def numbers(a: str, b: str) -> str:
        return f"(select explode(sequence({a}, {b})) as n)"

    @staticmethod
    def start(seconds: str) -> str:
        return f"timestamp_micros(cast({seconds} as bigint))"


class Duck(Spark):
    """Spellings of the engine that results are compared with."""

    name = "duck"

    @staticmethod
    def micros(ts: str) -> str:
        return f"epoch_us({ts})"

    @staticmethod
    def json(column: str, key: str) -> str:
        return f"json_extract_string({column}, '$.{key}')"

    @staticmethod
    def join(value: str, sep: str, *order: str) -> str:
        return f"string_agg({value}, '{sep}' order by {', '.join(order)})"

    @staticmethod
    def latest(value: str, *order: str) -> str:
        return f"arg_max({value}, ({', '.join(order)}))"

    @staticmethod
    def earliest(value: str, *order: str) -> str:
        return f"arg_min({value}, ({', '.join(order)}))"

    @staticmethod
    def join_distinct(value: str, sep: str) -> str:
        return f"string_agg(distinct {value}, '{sep}' order by {value})"

    @staticmethod
    def numbers(a: str, b: str) -> str:
        return f"(select unnest(generate_series({a}, {b})) as n)"


SPARK, DUCK = Spark(), Duck()

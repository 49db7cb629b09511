"""What SQL texts can call: the recogniser hook as a table function, validators and keys as SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from cardweave.functions import constants as C

TOKENS = "label string, tok_idx int, pass_name string, text string, score double, box array<array<double>>"


def register_recogniser(spark: SparkSession, name: str, fn: Callable[[bytes, str], list[tuple[str, float, list]]], passes: tuple[str, ...] = ("normal",)) -> None:
    """``SELECT * FROM name(TABLE(assets) PARTITION BY label)``: tokens of each asset (label, content) in each pass.

    Tokens of an asset are numbered from pass to pass. A pass that fails yields none.
    """

    class Recogniser:
        def __init__(self):
            self.n = 0

        def eval(self, row: Row) -> Iterator[tuple]:
            if row["content"] is None:
                return
            for p in passes:
                try:
                    found = fn(bytes(row["content"]), p)
                except Exception:  # noqa: BLE001  the recogniser is the caller's: its failure is an empty pass
                    continue
                for text, score, box in found:
                    yield row["label"], self.n, p, text, float(score), box
                    self.n += 1

    spark.udtf.register(name, udtf(Recogniser, returnType=TOKENS))


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _hint(hints: list[str]) -> str:
    """A text holds one of the hints."""
    return "lower(t) rlike " + _quoted("|".join("".join(f"[{c}]" if not c.isalnum() and c != " " else c for c in h) for h in hints))


def sql_functions() -> dict[str, tuple[str, str]]:
    """(type, body) of each function of a text ``t``."""
    letters, length = r"regexp_count(t, r'\p{L}')", "greatest(1, length(t))"
    digits, words = r"regexp_count(t, r'\p{Nd}')", r"regexp_count(t, r'(?U)\S+')"
    postal = " or ".join(f"t rlike {_quoted(p)}" for _, p in C.POSTAL)
    upper = r"(t rlike r'\p{Lu}' and not t rlike r'\p{Ll}')"
    any_hint = " or ".join(_hint(h) for h in (C.ADDRESS_HINTS, C.JOB_HINTS, C.COMPANY_HINTS))
    return {
        "card_key": ("STRING", "regexp_replace(translate(lower(coalesce(t, '')), 'l|oqsbz', '110g582'), '[^a-z0-9]', '')"),
        "valid_email": ("BOOLEAN", f"t rlike {_quoted(C.EMAIL_FULL)} and t rlike r'(?i)@.*[a-z0-9-]\\.[a-z]{{2}}[a-z0-9-]*$'"),
        "valid_phone": ("BOOLEAN", f"{digits} between 7 and 15 and not ({postal})"),
        "valid_website": ("BOOLEAN", f"t rlike {_quoted(C.URL)}"),
        "valid_address": ("BOOLEAN", f"({postal}) or ({letters} / {length} >= 0.55 and {digits} >= 1)"),
        "valid_name": ("BOOLEAN", f"t != '' and {digits} = 0 and {words} between 1 and 4 and not ({any_hint}) and {letters} / {length} >= 0.7"),
        "valid_title": ("BOOLEAN", f"{_hint(C.JOB_HINTS)} and {letters} / {length} >= 0.55"),
        "valid_company": ("BOOLEAN", f"t != '' and ({_hint(C.COMPANY_HINTS)} or ({digits} = 0 and (({upper} and length(t) <= 32) or ({words} between 1 and 4 and {letters} / {length} >= 0.55))))"),
    }


def register_functions(spark: SparkSession) -> None:
    """The functions of ``sql_functions`` as temporary ones of the session; their bodies are part of a query's plan, so nothing leaves the JVM."""
    for name, (kind, body) in sql_functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {body}")

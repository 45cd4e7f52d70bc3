"""The drift report as Markdown (English or Korean) and as plain text.

Lines are Column expressions over the findings, whose number is bounded by the places of two models; the text is their
ordered aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import diff
from .model import Model

NONE = "—"
SEVERITIES = ("breaking", "risky", "info")
KINDS = (
    "endpoint-removed", "endpoint-added", "status-removed", "status-added", "field-removed", "field-added", "type-changed", "nullability-changed", "optionality-changed", "enum-values-changed",
    "format-changed", "request-changed", "query-changed", "params-changed",
)
#: The words of each language, in the order of ``SEVERITIES`` and ``KINDS``.
WORDS = {
    "en": {
        "title": "drift report",
        "summary": "Compared `{a}` (a) → `{b}` (b): {breaking} breaking, {risky} risky, {info} info · {compared} endpoints compared, {only_a} only in a, {only_b} only in b.",
        "none": "No drift detected.",
        "low": "⚠ low confidence: backed by fewer than {n} observed samples — re-record with more traffic before acting on these findings.",
        "columns": ("Kind", "Endpoint", "Path", "Change", "Samples (b)"),
        "severities": ("Breaking", "Risky", "Info"),
        "kinds": (
            "endpoint removed", "endpoint added", "response status removed", "response status added", "field removed", "field added", "type changed", "nullability changed",
            "optionality changed", "enum values changed", "format changed", "request body changed", "query changed", "path params changed",
        ),
    },
    "ko": {
        "title": "드리프트 리포트",
        "summary": "`{a}`(a) → `{b}`(b) 비교: 호환성 깨짐 {breaking}건, 위험 {risky}건, 참고 {info}건 · 비교한 엔드포인트 {compared}개, a에만 {only_a}개, b에만 {only_b}개.",
        "none": "드리프트가 감지되지 않았습니다.",
        "low": "⚠ 낮은 신뢰도: 관측 샘플이 {n}개 미만인 판정입니다 — 조치 전에 더 많은 트래픽으로 다시 녹화하세요.",
        "columns": ("종류", "엔드포인트", "경로", "변경", "샘플 수(b)"),
        "severities": ("호환성 깨짐", "위험", "참고"),
        "kinds": (
            "엔드포인트 삭제", "엔드포인트 추가", "응답 상태코드 삭제", "응답 상태코드 추가", "필드 삭제", "필드 추가", "타입 변경", "null 허용 여부 변경", "optional 여부 변경", "enum 값 변경",
            "포맷 변경", "요청 바디 변경", "쿼리 변경", "경로 파라미터 변경",
        ),
    },
}


def language(name: str | None) -> str:
    """A language there are words of; English for any other."""
    return name if name in WORDS else "en"


def _label(column: str, names: tuple[str, ...], words: tuple[str, ...]) -> Column:
    return reduce(lambda c, x: c.when(F.col(column) == x[0], x[1]), list(zip(names, words, strict=True))[1:], F.when(F.col(column) == names[0], words[0]))


def _place(none: str) -> Column:
    status = F.when(F.col("status").isNotNull(), F.concat(F.lit("["), F.col("status").cast("string"), F.lit("]")))
    return F.coalesce(F.nullif(F.concat_ws(" ", status, "path"), F.lit("")), F.lit(none))


def _change(none: str) -> Column:
    return F.concat(F.coalesce("before", F.lit(none)), F.lit(" → "), F.coalesce("after", F.lit(none)))


def _samples(none: str) -> Column:
    return F.coalesce(F.concat(F.col("b_samples").cast("string"), F.when(diff.low_confidence(F.col("b_samples")), " ⚠").otherwise("")), F.lit(none))


def _ordered(found: DataFrame, line: Column) -> DataFrame:
    """(severity, n, lines, low) of each severity: its lines in the report's order."""
    key = F.struct("endpoint", F.coalesce("path", F.lit("")).alias("path"), "kind", "seq", line.alias("line"))
    listed = F.transform(F.sort_array(F.collect_list(key)), lambda x: x["line"])
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, "\n").alias("lines"), F.bool_or(diff.low_confidence(F.col("b_samples"))).alias("low"))


def _fill(template: str, **columns: Column) -> Column:
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def _document(a: Model, b: Model, found: DataFrame, sections: DataFrame, head: Column, none: str, low: str) -> DataFrame:
    body = sections.agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n").alias("body"), F.coalesce(F.bool_or("low"), F.lit(False)).alias("low")
    )
    last = F.when(F.col("body") == "", f"\n{none}").otherwise(F.concat("body", F.when(F.col("low"), f"\n\n{low}").otherwise("")))
    return diff.summary(a, b, found).join(body).select(F.concat(head, F.lit("\n"), last, F.lit("\n")).alias("content"))


def _rank() -> Column:
    return F.when(F.col("severity") == "breaking", 0).when(F.col("severity") == "risky", 1).otherwise(2)


def markdown(a: Model, b: Model, found: DataFrame, lang: str | None = "en") -> DataFrame:
    """One row, ``content``: the report in Markdown."""
    words = WORDS[language(lang)]
    cells = [_label("kind", KINDS, words["kinds"]), F.col("endpoint"), _place(NONE), _change(NONE), _samples(NONE)]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[S.escape_cell(c) for c in cells]), F.lit(" |"))
    title = F.concat(F.lit("\n## "), _label("severity", SEVERITIES, words["severities"]), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"))
    table = "| " + " | ".join(words["columns"]) + " |\n|" + " --- |" * len(words["columns"]) + "\n"
    sections = _ordered(found, line).select(_rank().alias("rank"), "low", F.concat(title, F.lit(table), "lines").alias("section"))
    counts = {"breaking": F.col("breaking"), "risky": F.col("risky"), "info": F.col("info"), "compared": F.col("endpoints_compared"), "only_a": F.col("endpoints_only_in_a"), "only_b": F.col("endpoints_only_in_b")}
    head = F.concat(F.lit(f"# {words['title']}\n\n"), _fill(words["summary"], a=F.lit(a.name), b=F.lit(b.name), **counts))
    return _document(a, b, found, sections, head, words["none"], words["low"].replace("{n}", str(diff.LOW_CONFIDENCE)))


def shorten(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def text_table(rows: DataFrame, columns: dict[str, Column], by: str, order: list[str]) -> DataFrame:
    """(``by``, n, table): for each group a table of padded columns with a header and a line under it."""
    cells = rows.select(by, *order, *[c.alias(f"c{k}") for k, c in enumerate(columns.values())])
    widths = cells.groupBy(F.col(by).alias("of")).agg(F.count(F.lit(1)).alias("n"), *[F.greatest(F.max(F.length(f"c{k}")), F.lit(len(h))).alias(f"w{k}") for k, h in enumerate(columns)])
    pad = lambda text, k: F.rpad(text, F.col(f"w{k}"), F.lit(" "))
    many = range(len(columns))
    line = F.rtrim(F.concat_ws(" | ", *[pad(F.col(f"c{k}"), k) for k in many]))
    d = cells.join(widths, F.col(by) == F.col("of")).withColumn("line", line)
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    grouped = d.groupBy(by, "n", *[f"w{k}" for k in many]).agg(lines.alias("lines"))
    head = F.rtrim(F.concat_ws(" | ", *[pad(F.lit(h), k) for k, h in enumerate(columns)]))
    rule = F.concat_ws(" | ", *[F.repeat(F.lit("-"), F.col(f"w{k}")) for k in many])
    return grouped.select(by, "n", F.concat_ws("\n", head, rule, "lines").alias("table"))


def plain(a: Model, b: Model, found: DataFrame) -> DataFrame:
    """One row, ``content``: the report as text for a terminal."""
    rows = found.withColumn("path_key", F.coalesce("path", F.lit("")))
    change = shorten(F.regexp_replace(_change("-"), r"\s+", " "))
    columns = {"SEVERITY": F.col("severity"), "KIND": F.col("kind"), "ENDPOINT": F.col("endpoint"), "PATH": _place(""), "CHANGE": change, "SAMPLES": _samples("-")}
    tables = text_table(rows, columns, "severity", ["endpoint", "path_key", "kind", "seq"])
    low = found.groupBy(F.col("severity").alias("of")).agg(F.bool_or(diff.low_confidence(F.col("b_samples"))).alias("low"))
    sections = tables.join(low, F.col("severity") == F.col("of")).select(_rank().alias("rank"), "low", F.concat(F.lit("\n"), F.upper("severity"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "table").alias("section"))
    ends = lambda m: m.endpoints.select("endpoint").distinct().count()
    head = F.format_string(
        f"diff — a: {a.name} ({ends(a)} endpoints) vs b: {b.name} ({ends(b)} endpoints)\n  %d breaking, %d risky, %d info · %d compared, %d only-in-a, %d only-in-b".replace("%%", "%"),
        "breaking", "risky", "info", "endpoints_compared", "endpoints_only_in_a", "endpoints_only_in_b",
    )
    low_text = f"⚠ low confidence: backed by fewer than {diff.LOW_CONFIDENCE} observed samples — re-record with more traffic before acting on these."
    return _document(a, b, found, sections, head, "no drift detected.", low_text)


def gen_table(model: Model) -> DataFrame:
    """One row, ``content``: endpoints with their statuses and samples as a table."""
    by = model.responses.groupBy("endpoint").agg(F.array_join(F.transform(F.sort_array(F.collect_list("status")), lambda s: s.cast("string")), ",").alias("statuses"), F.sum("count").alias("n_samples"))
    rows = model.endpoints.join(by, "endpoint").withColumn("all", F.lit("all"))
    columns = {"METHOD": F.col("method"), "PATTERN": F.col("pattern"), "STATUSES": F.col("statuses"), "SAMPLES": F.col("n_samples").cast("string")}
    return text_table(rows, columns, "all", ["pattern", "method"]).select(F.col("table").alias("content"))

"""Secret scans over versioned files with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text, so a blob that many paths or versions hold is
scanned once. A ledger table keeps which (blob, rule set, rule version) pairs were scanned and what was found; a run scans
only pairs that the ledger lacks, appends them, and joins the findings back to all paths and versions that hold the blob.
Raising the version of one rule set rescans blobs for that set alone. Copies of a blob are merged before they are
shuffled, so a text that a third of all paths hold is no hot group. A pair that is in the ledger more than once, as after
two runs at a time, counts once: what a scan finds depends on blob and rules alone, so its rows are equal.

Spans are code points, end exclusive. The ``base`` rule set is: assignments to password-like names, access key ids and
long lower-case hex runs, each leftmost and non-overlapping, with too short matches dropped after they have taken their
text. The ``extra`` set adds other well-known token shapes.

Defined cases: a null text is the empty text; null paths are kept; repeated rows are repeated versions with the same
findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weaklabel.llm.common import slices, whole, written

SLICE_BYTES = 4 << 20


@dataclass(frozen=True)
class Kind:
    """One kind of secret: ``group`` of a match must have ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


@dataclass(frozen=True)
class RuleSet:
    name: str
    version: int
    kinds: tuple[Kind, ...]


BASE = RuleSet(
    "base",
    1,
    (
        Kind("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
        Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
        Kind("hex", r"[0-9a-f]+", 0, 24),
    ),
)
EXTRA = RuleSet(
    "extra",
    2,
    (
        # lines like "Proc-Type: ..." may stand before the key
        Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:\s*[A-Za-z0-9-]+:[^\n]*\n)*+[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
        Kind("hosted", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
        Kind("signed", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
        Kind("bearer", r"(?i:\bbearer)\x20+([A-Za-z0-9._~+/-]{20,}=*)"),
        # from the end of the scheme on, so that no start is tried for every letter of a long run
        Kind("url", r"://[^\s/:@]*+:([^\s/:@]+)@", 1, 3),
    ),
)
FINDINGS = "blob string, rule_set string, rule_version int, spans array<struct<kind:string,start:int,stop:int>>"


def spans_of(text: str, rules: RuleSet) -> list[tuple[str, int, int]]:
    """Matches (kind, start, stop) of a rule set, by start and then by the order of kinds."""
    found = []
    for order, kind in enumerate(rules.kinds):
        for m in _compiled(kind).finditer(text):
            if m.end(kind.group) - m.start(kind.group) >= kind.least:
                found.append((m.start(), order, kind.name, m.end()))
    return [(name, start, stop) for start, _, name, stop in sorted(found)]


_patterns: dict[Kind, re.Pattern] = {}


def _compiled(kind: Kind) -> re.Pattern:
    if kind not in _patterns:
        pattern = kind.pattern
        # a run of one class that is too short can never be part of a longer match of the same pattern
        if re.fullmatch(r"[A-Z]*\[[^]]*\]\+", pattern) and kind.least > 1:
            literal = pattern.index("[")
            pattern = f"{pattern[:-1]}{{{kind.least - literal},}}"
        _patterns[kind] = re.compile(pattern, re.ASCII | (re.IGNORECASE if kind.any_case else 0))
    return _patterns[kind]


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty if there is none yet."""
    try:
        return spark.read.schema(FINDINGS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], FINDINGS)


def update_ledger(versions: DataFrame, path: str, rule_sets: tuple[RuleSet, ...] = (BASE, EXTRA), text_column: str = "text") -> DataFrame:
    """Scan the blobs of ``versions`` for every rule set and version that the ledger lacks, append, and return the ledger.

    A run that fails leaves no half-written rows: Spark commits an append as a whole, so the next run scans again.
    """
    spark = versions.sparkSession
    known = read_ledger(spark, path)
    wanted = [(r.name, r.version) for r in rule_sets]
    done = known.where(F.array_contains(F.array(*[F.lit(f"{n}:{v}") for n, v in wanted]), F.concat_ws(":", "rule_set", "rule_version")))
    done = done.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule_set", "rule_version")).alias("done"))
    blobs = versions.select(F.sha2(whole(text_column), 256).alias("blob"), whole(text_column).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    unseen = blobs.join(done, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    unseen = unseen.where(F.size("done") < len(wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        for part in slices(batches, "text", SLICE_BYTES):
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for blob, text, seen in zip(*(part.column(c).to_pylist() for c in ("blob", "text", "done"))):
                for rules in rule_sets:
                    if f"{rules.name}:{rules.version}" not in seen:
                        found = [{"kind": k, "start": a, "stop": b} for k, a, b in spans_of(text, rules)]
                        for into, value in zip(rows, (blob, rules.name, rules.version, found)):
                            into.append(value)
            kinds = (pa.string(), pa.string(), pa.int32(), span)
            yield pa.record_batch([pa.array(v, k) for v, k in zip(rows, kinds)], names=["blob", "rule_set", "rule_version", "spans"])

    unseen.mapInArrow(work, FINDINGS).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings(versions: DataFrame, ledger: DataFrame, keep: list[str], rule_sets: tuple[RuleSet, ...] = (BASE, EXTRA), text_column: str = "text") -> DataFrame:
    """Each version (columns ``keep``) with blob and, for each rule set, a column of its spans."""
    own = versions.select(*keep, F.sha2(whole(text_column), 256).alias("blob"))
    none = F.array().cast(ledger.schema["spans"].dataType)
    by_set = [F.coalesce(F.max(F.when((F.col("rule_set") == r.name) & (F.col("rule_version") == r.version), F.col("spans"))), none).alias(f"spans_{r.name}") for r in rule_sets]
    found = ledger.groupBy("blob").agg(*by_set)
    found = found.where(F.lit(False) if not rule_sets else F.greatest(*[F.size(f"spans_{r.name}") for r in rule_sets], F.lit(0)) > 0)
    # a written table, so that Spark can split the versions of a blob that very many paths hold
    joined = own.join(written(found, "secret-findings"), "blob", "left")
    for r in rule_sets:
        column = f"spans_{r.name}"
        joined = joined.withColumn(column, F.coalesce(column, F.array().cast(found.schema[column].dataType)))
    return joined


def span_text(spans, kinds: list[str]):
    """Spans as kind:start:end, by start and then by the order of ``kinds``, joined by commas."""
    order = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("order"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    parts = F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    return F.array_join(parts, ",")


def digest(found: DataFrame, keep: list[str]) -> DataFrame:
    """Counts and digests of the spans of the base set, and all spans as text."""
    base = F.col("spans_base")
    names = [k.name for k in BASE.kinds]

    def count(name: str):
        return F.size(F.filter(base, lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")

    both = F.concat(base, F.col("spans_extra"))
    return found.select(
        *keep,
        *(count(n) for n in names),
        F.sha2(span_text(base, names), 256).alias("base_sha256"),
        span_text(both, [*names, *(k.name for k in EXTRA.kinds)]).alias("spans"),
    )

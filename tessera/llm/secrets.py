"""Secret scans with an incremental blob ledger.

A text is a blob, named by its SHA-256; a history is a table of versions, each of which
holds blobs at paths (doc_id). The ledger keeps the findings of every blob and rule
version that was ever scanned, with an empty list for clean ones. A scan looks only at
blobs of the history that the ledger lacks under the present rule version, one copy of
each, and the findings are joined back to all versions and paths. A table of documents
is a history of one version.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, over_arrow

#: Base rules, in the order that breaks ties of start.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more are the long ones of [0-9a-f]+
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
#: More kinds, each with a string that every match holds.
MORE = (
    ("pem", "-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?s:.*?-----END [A-Z ]*PRIVATE KEY-----)?")),
    ("jwt", "eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("forge", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("cloud", "AIza", re.compile(r"\bAIza[A-Za-z0-9_-]{35}")),
)
KINDS = ("assign", "access", "hex", *(k for k, _, _ in MORE))
RULES_VERSION = 1
LEDGER = "sha string, rules int, spans array<struct<start:long,end:long,kind:int>>"


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start and then kind as listed; leftmost and non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    for kind, (_, word, rule) in enumerate(MORE, 3):
        if word in text:
            out += [(m.start(), m.end(), kind) for m in rule.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _scan(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32())]))
    found = [[{"start": s, "end": e, "kind": k} for s, e, k in spans(t)] for t in b.column("text").to_pylist()]
    yield pa.RecordBatch.from_arrays([b.column("sha"), pa.array([RULES_VERSION] * len(found), pa.int32()), pa.array(found, kind)], ["sha", "rules", "spans"])


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(paths, new): (version, doc_id, path, sha) of every row, where path is doc_id or the least long for null, and the ledger rows of blobs that the ledger lacks.

    `version` names the column (long) that parts a history's versions; without it all is
    version 0. Append `new` to the ledger; findings() joins both back to the paths.
    """
    at = F.lit(0) if version is None else F.coalesce(version, F.lit(-1))
    named = docs.select(at.cast("long").alias("version"), "doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("path"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    paths = materialize(named.select("version", "doc_id", "path", "sha"), "paths")
    # One version and path for each blob, by partial aggregates.
    blobs = paths.groupBy("sha").agg(F.min("path").alias("path")) if version is None else paths.groupBy("sha").agg(F.min(F.struct("version", "path")).alias("x")).select("sha", "x.*")
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules") == RULES_VERSION).select("sha"), "sha", "left_anti")
    # The texts are shuffled once and not sorted; the ids are the build side of each partition.
    todo = named.join(blobs.hint("shuffle_hash"), ["path", "sha"] if version is None else ["version", "path", "sha"]).select("sha", "text")
    return paths, materialize(over_arrow(todo, _scan, LEDGER).groupBy("sha", "rules").agg(F.max("spans").alias("spans")), "ledger")


def findings(paths: DataFrame, ledger: DataFrame) -> DataFrame:
    """(version, doc_id, spans) for every version and path; clean blobs give an empty list."""
    hits = ledger.where((F.col("rules") == RULES_VERSION) & (F.size("spans") > 0)).select("sha", "spans")
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")
    return paths.join(hits, "sha", "left").select("version", "doc_id", F.coalesce("spans", none).alias("spans"))


def scan_history(history: DataFrame, ledger: DataFrame | None = None, version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(found, ledger): findings (version, doc_id, spans) of every row of a history, and the ledger with what was new.

    Versions may come in one table or a few at a time: what an earlier call has scanned
    isn't scanned again.
    """
    paths, new = scan_unseen(history, ledger, version)
    known = new if ledger is None else ledger.select(*new.columns).unionAll(new)
    return findings(paths, known), known


def secret_digest(found: DataFrame) -> DataFrame:
    """The counts and strings of op7's contract."""
    names = F.array(*map(F.lit, KINDS))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One row for each row of docs, by way of the ledger.

    Null text counts as empty and has no spans. Texts are scanned whole. Equal texts are
    scanned once and each path gets the findings; two rows with one doc_id and text give
    two rows. An empty table gives none. Only doc_id and text are read.
    """
    paths, new = scan_unseen(docs, ledger)
    known = new if ledger is None else ledger.select(*new.columns).unionAll(new)
    return secret_digest(findings(paths, known))

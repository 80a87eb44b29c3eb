"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of a document is a path that points to a blob, named by the SHA-256 of its text. Only
blobs without a ledger row for the current rule version are scanned, each once; findings join back to
all paths. The ledger rows of one run are the input of the next.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import join_heavy, saved, slices, strings

RULE_VERSION = "1"
KINDS = ("assign", "access", "hex", "pem")
#: The patterns of the contract, and one more kind for key blocks.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Possessive, so that no blank is read twice: header lines behind white space, then the key; or white space and the key.
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?>[\x20\x09-\x0D]++(?:[A-Za-z0-9-]+: [^\n]*\n)++|[\x20\x09-\x0D])[A-Za-z0-9+/=\x20\x09-\x0D]++-----END (?:[A-Z]+ )*PRIVATE KEY-----")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Digests that a task remembers, so that copies are sent once.
REMEMBERED = 200_000
LEDGER = "blob string, rule_version string, spans array<string>"


def find(text: str) -> list[tuple[int, int, str]]:
    """All spans as (start, end, kind) in code points, by start, then kind as listed."""
    found = []
    if any(w in low for w in WORDS) if (low := text.lower()) else False:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [(*m.span(), "pem") for m in PEM.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def one_per_blob(rows: DataFrame) -> DataFrame:
    """The first (blob, text) of each blob in each task; a task remembers the digests of its last texts only, so that a few may pass again."""
    def run(batches):
        seen: set[str] = set()
        for b in slices(batches):
            if len(seen) > REMEMBERED:
                seen.clear()
            new = [x not in seen and not seen.add(x) for x in b.column(0).to_pylist()]
            if any(new):
                yield b.filter(pa.array(new, pa.bool_()))

    return rows.select("blob", "text").mapInArrow(run, "blob string, text string")


def scan_blobs(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the given (blob, text) rows, one for each blob; spans are kind:start:end. A task remembers its last blobs only: what it scans again is dropped."""
    def run(batches):
        seen: set[str] = set()
        for b in slices(batches):
            if len(seen) > REMEMBERED:
                seen.clear()
            b = b.filter(pa.array([x not in seen and not seen.add(x) for x in b.column(0).to_pylist()], pa.bool_()))
            if b.num_rows:
                spans = [[f"{k}:{s}:{e}" for s, e, k in find(x)] for x in strings(b, "text")]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rule_version] * b.num_rows), pa.array(spans, pa.list_(pa.string()))], ["blob", "rule_version", "spans"])

    return blobs.select("blob", "text").mapInArrow(run, LEDGER).dropDuplicates(["blob"])


def scan(versions: DataFrame, *, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows) of all ``versions``: one findings row per input row, with path, blob and spans.

    ``ledger`` holds blob, rule_version, spans of earlier runs; None means an empty one. A null text is
    the empty blob; repeated rows keep a row each; a path may have many versions; columns besides the two
    named are ignored. Copies meet before the shuffle: each task sends one text per blob, so a blob that
    holds a third of all rows costs one text per task, and its findings are broadcast to its paths. Texts
    are dealt out by blob without a sort; the task that gets a blob scans it once.
    """
    rows = versions.select(F.col(path_col).alias("path"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    blobs = one_per_blob(rows).repartition("blob")
    if ledger is not None:
        done = ledger.where(F.col("rule_version") == rule_version)
        # Dealt out by blob already, and hashed, so that no text is shuffled again or sorted.
        blobs = blobs.join(done.select("blob").hint("shuffle_hash"), "blob", "left_anti")
    new = saved(scan_blobs(blobs, rule_version))
    known = new if ledger is None else new.unionByName(done.select("blob", "rule_version", "spans"))
    paths = saved(rows.select("path", "blob"))
    found = known.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    counts = paths.groupBy("blob").agg(F.count("*").alias("n"))
    joined = join_heavy(paths, found, "blob", counts, "left")
    return joined.select(F.col("path").alias(path_col), "blob", F.coalesce("spans", F.array().cast("array<string>")).alias("spans")), new


def redact(docs: DataFrame, findings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the secret spans of their texts replaced by [SECRET]; the columns stay as they are.

    Spans apply only to rows whose text has the blob that was scanned, so a changed text is left alone. Null texts stay null,
    repeated rows are redacted alike, columns may have any names; an empty table gives an empty one.
    """
    spans = findings.where(F.size("spans") > 0).select("blob", "spans").groupBy("blob").agg(F.first("spans").alias("spans"))
    schema = docs.schema
    # The row is one column, so that no name of it can clash.
    keyed = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("blob"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    counts = findings.groupBy("blob").agg(F.count("*").alias("n"))
    keyed = join_heavy(keyed, spans, "blob", counts, "left").select("row", "spans")
    at = docs.columns.index(text_col)

    def run(batches):
        for b in slices(batches):
            row = b.column(0)
            out = [cut(text, found) if found else text for text, found in zip(row.field(at).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == at else row.field(k) for k in range(len(schema.names))], schema.names)

    return keyed.mapInArrow(run, schema)


def cut(text: str, spans: list[str]) -> str:
    """The text with overlapping spans united and each replaced."""
    out, at, last = [], 0, -1
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans):
        if start >= last:
            out += [text[at:start], "[SECRET]"]
        last = max(last, end)
        at = last
    return "".join(out) + text[at:]

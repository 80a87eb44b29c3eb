"""The thin queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import bpe, decontam, dialogue, lm, merkle, neardup, pages, quality, repeats, secrets, tokencount, toxicity, whitening
from spanforge.llm.common import saved

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The versions come in two deliveries; the second scans only what the ledger of the first lacks, and all rows get their findings.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(2)) == 0).alias("first"))
    early, ledger = secrets.scan(docs.where("first"))
    late, _ = secrets.scan(docs.where("not first"), ledger=ledger)
    found = early.unionByName(late)
    base = F.filter("spans", lambda s: ~s.startswith("pem:"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def op2_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op3_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.rotate(table(spark, sf_dir, "conversations"))


def op4_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Trees of all documents are kept first; the edits then work on what is kept.
    kept = saved(tokencount.trees(table(spark, sf_dir, "documents").select("doc_id", "text"), BPE_FILE), "zstd")
    todo = kept.withColumn("edits", tokencount.sample_edits(F.col("doc_id"), F.length(F.coalesce("text", F.lit("")))))
    edited = tokencount.edit(todo, "edits", BPE_FILE)
    return edited.select("doc_id", "n_before", F.col("n_tokens").alias("n_after"), "n_pretokens", "n_reencoded", F.sha2(F.coalesce("text", F.lit("")), 256).alias("edited_sha256"))


def op5_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", F.sha2("cleaned", 256).alias("cleaned_sha256"))


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BPE_FILE)


def op11_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_column_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A fifth of the rows come back with their capitals lost; their folded roots show it.
    suspect = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered={"text": merkle.lowered(F.col("text"))}, suspect=suspect)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ledger": op1_secret_ledger,
    "op2_probminhash": op2_probminhash,
    "op3_perspectives": op3_perspectives,
    "op4_edit_aware_counts": op4_edit_aware_counts,
    "op5_deobfuscated_toxicity": op5_deobfuscated_toxicity,
    "op6_line_first": op6_line_first,
    "op7_site_style_tree": op7_site_style_tree,
    "op8_pseudo_likelihood": op8_pseudo_likelihood,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_spectrum_slicing": op11_spectrum_slicing,
    "op12_column_bwt": op12_column_bwt,
    "op13_octopus_manifest": op13_octopus_manifest,
}

SPACES = r"[\x20\x09-\x0D]"


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_count(column: str, letters: str) -> str:
    return f"(length({column}) - length(translate({column}, '{letters}', '')))"


def op6_sql() -> str:
    symbols, bars, ends, boiler, nav = sql_count("line", quality.SYMBOLS), sql_count("line", "|»›•·"), sql_text(quality.ENDS), sql_text(quality.BOILERPLATE), sql_text(quality.NAVIGATION)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{SPACES}+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, k, struct_pack(a := w[k], b := w[k + 1], c := w[k + 2]) AS t FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d WHERE len(w) >= 3)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
ln AS (SELECT doc_id, k, line, regexp_replace(line, '{SPACES}', '', 'g') AS solid, regexp_replace(line, '{SPACES}+\z', '') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM d)),
lw AS (SELECT *, len(list_filter(string_split_regex(line, '{SPACES}+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS rn FROM ln WHERE length(solid) > 0),
bad AS (SELECT doc_id, k, line, length(solid) AS chars, rn > 1 AS again, rn > 1 OR (n < 8 AND NOT regexp_matches(t, {ends})) OR ({symbols} >= 3 AND 10 * {symbols} > 3 * n) OR ({bars} >= 3 AND 5 * {bars} > n)
  OR (n <= 6 AND regexp_matches(t, {nav})) OR (n <= 25 AND regexp_matches(t, {boiler})) OR (n >= 3 AND length(line) - length(regexp_replace(line, '\p{{Lu}}', '', 'g')) > 2 * (length(line) - length(regexp_replace(line, '\p{{Ll}}', '', 'g')))) AS bad FROM lw),
lost AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, CAST(coalesce(sum(chars) FILTER (bad), 0) AS BIGINT) AS lost_chars, string_agg(line, chr(10) ORDER BY k) FILTER (NOT bad) AS cleaned FROM bad GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '{SPACES}', '', 'g')) AS word_chars, {sql_count("text", quality.SYMBOLS)} AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost_chars, 0) AS lost_chars, sha256(coalesce(cleaned, '')) AS cleaned_sha256
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM m""".replace("\\\\", "\\")


def op13_sql() -> str:
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"
    leaf = lambda text: "sha256(" + " || ".join(f"({field(x)})" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    return f"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)])), 4294967295) % 5 = 0 AS suspect FROM documents, crc),
leaves AS (SELECT doc_id, source, {leaf("text")} AS h, CASE WHEN suspect THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {leaf("text")} END AS g FROM raw),
placed AS (SELECT *, dense_rank() OVER (ORDER BY source IS NOT NULL, encode(source)) AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id, h) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves),
up AS (SELECT tree, 0 AS level, idx, n, h FROM placed
  UNION ALL SELECT tree, level + 1, idx // 16, (n - 1) // 16 + 1, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, level, n, idx // 16),
top AS (SELECT 0 AS tree, 0 AS level, tree - 1 AS idx, count(*) OVER () AS n, h FROM up WHERE n = 1
  UNION ALL SELECT tree, level + 1, idx // 16, (n - 1) // 16 + 1, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY tree, level, n, idx // 16),
nodes AS (SELECT * FROM up UNION ALL SELECT * FROM top),
kin AS (SELECT x.tree, x.level, x.idx, x.n, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx < x.idx), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.idx) FILTER (y.idx > x.idx), '') AS r
  FROM nodes x JOIN nodes y ON x.tree = y.tree AND x.level = y.level AND x.idx // 16 = y.idx // 16 GROUP BY x.tree, x.level, x.idx, x.n),
walk AS (SELECT doc_id, h AS leaf, tree, tree AS own, 0 AS level, idx, '' AS proof, g AS f FROM placed
  UNION ALL SELECT doc_id, leaf, CASE WHEN k.n = 1 THEN 0 ELSE w.tree END, own, CASE WHEN k.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN k.n = 1 THEN w.tree - 1 ELSE w.idx // 16 END,
    CASE WHEN k.n = 1 THEN proof ELSE proof || l || r END, CASE WHEN k.n = 1 THEN f ELSE sha256(l || f || r) END
  FROM walk w JOIN kin k ON w.tree = k.tree AND w.level = k.level AND w.idx = k.idx WHERE NOT (w.tree = 0 AND k.n = 1)),
done AS (SELECT w.* FROM walk w JOIN top t ON w.tree = 0 AND t.level = w.level AND t.n = 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM done JOIN top t ON t.n = 1 JOIN up s ON s.tree = own AND s.n = 1"""


#: Matches of a pattern with their starts, from the matches and the texts between them.
SPANS = """
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(generate_series(1, len(m))) AS k, m[k] AS found,
         1 + list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) - 1 AS s
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}', 0{flags}) AS m, string_split_regex(coalesce(text, ''), '{pattern}'{flags}) AS gaps FROM documents)
  WHERE len(m) > 0"""
#: The names in either case of their ASCII letters, and no other letters that fold to them.
NAMES_SQL = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
GROUP_SQL = rf"""^(?:{NAMES_SQL})["'']?\x20*[:=]\x20*["'']?"""
ASSIGN_SQL = GROUP_SQL[1:] + "[A-Za-z0-9+/_.=-]+"
BLANKS_SQL = r"\x20\x09-\x0D"
PEM_SQL = rf"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[{BLANKS_SQL}]+(?:[A-Za-z0-9-]+: [^\n]*\n)*[A-Za-z0-9+/={BLANKS_SQL}]+-----END (?:[A-Z]+ )*PRIVATE KEY-----"

SQL: dict[str, str] = {
    "op1_secret_ledger": f"""
WITH spans AS ({SPANS.format(kind="assign", rank=0, pattern=ASSIGN_SQL, flags="")}
  UNION ALL {SPANS.format(kind="access", rank=1, pattern="AKIA[A-Z0-9]+", flags="")}
  UNION ALL {SPANS.format(kind="hex", rank=2, pattern="[0-9a-f]+", flags="")}
  UNION ALL {SPANS.format(kind="pem", rank=3, pattern=PEM_SQL, flags="")}),
good AS (SELECT doc_id, kind, rank, s, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(found) AS BIGINT) AS span FROM spans
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(found, '{GROUP_SQL}', '')) >= 12 WHEN 'access' THEN length(found) >= 18 ELSE length(found) >= 16 END),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, rank) AS spans, string_agg(span, ',' ORDER BY s, rank) FILTER (kind <> 'pem') AS base FROM good GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN per USING (doc_id)""",
    "op2_probminhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
rep AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep FROM w),
sh AS (SELECT DISTINCT rep, hash(array_to_string(w[k:k + 4], ' ')) AS s FROM (SELECT rep, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS k FROM rep WHERE rep = doc_id AND len(w) > 0)),
n AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep),
pairs AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.rep <> y.rep GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n na ON na.rep = a JOIN n nb ON nb.rep = b WHERE c >= 0.8 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS rep, least(a, min(b)) AS root FROM reach GROUP BY a),
per AS (SELECT doc_id, coalesce(root, rep.rep) AS class_id FROM rep LEFT JOIN root ON root.rep = rep.rep)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM per""",
    "op3_perspectives": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS speaker, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, CASE WHEN role = 'user' THEN '<|im_start|>user name=' || translate(replace(speaker, '<|im_', '<| im_'), chr(10) || chr(13), '  ') ELSE '<|im_start|>' || role END || chr(10) AS head FROM r),
s AS (SELECT *, head || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_end FROM s)
SELECT conv_id, perspective, turn, role, speaker, segment, seg_end - length(segment) AS seg_start, seg_end,
  CASE WHEN role = 'assistant' THEN seg_end - length(segment) + length(head) ELSE seg_end END AS loss_start, seg_end AS loss_end FROM o""",
    "op6_line_first": op6_sql(),
    "op9_decontaminate": r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
seen AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS k FROM folded WHERE len(w) > 0), sizes WHERE k + n - 1 <= len(w)),
occ AS (SELECT DISTINCT doc_id, k, n, item_id FROM seen JOIN wins USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM folded f LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op12_column_bwt": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s FROM (SELECT *, unnest(range(n - 49)) AS k FROM d WHERE n >= 50)),
hit AS (SELECT doc_id, k FROM w JOIN (SELECT s, min(doc_id) AS low FROM w GROUP BY s) USING (s) WHERE low < doc_id),
run AS (SELECT doc_id, k, sum(f) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS f FROM hit)),
span AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM run GROUP BY doc_id, c),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, n AS a, n AS z FROM d)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p) AS x FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
per AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN per USING (doc_id)""",
    "op13_octopus_manifest": op13_sql(),
}

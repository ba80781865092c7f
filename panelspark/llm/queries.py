"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import (
    embeddings_join, html_text, minhash, mixing, quality_pu, secrets, shard_tree, tandem_runs, templates, token_counts, token_files, url_rules, vector_codes,
)
from panelspark.llm.common import fresh_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"), rules=secrets.EntropyRules(segments=True))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.token_index(spark, out)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.mix_documents(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_components(_table(spark, sf_dir, "documents"), minhash.NearSettings(words=4))
    return rows.select("doc_id", "n_shingles", "component_id", "kept")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "matched", "share", "exact").distinct()


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings_join.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight shards, and a ninth in a region of its own."""
    return shard_tree.with_slots(shard_tree.assign(_table(spark, sf_dir, "documents"), shard_tree.tree_of(8), shard_tree.tree_of(9)))


def periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where h = crc32 of the id's digits ends in 0, words from a = g % n on repeat those from a to a + p, with g = h // 10; other texts, and those of null ids, as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select("doc_id", "text", F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("a", (F.col("g") % F.size("w")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.size("w") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.transform("w", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p"))))
    return rows.select("doc_id", F.when(F.col("w").isNull(), F.col("text")).otherwise(F.array_join(tail, " ")).alias("text"))


def op12_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tandem_runs.find_runs(periodic_tails(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))))
    return rows.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("longest.start")).alias("start"), F.col("longest.length").alias("length"), (-F.col("longest.period")).alias("period"),
        F.expr("-(1000 * longest.length div longest.period)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_errors(coded)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS ord FROM documents
), g AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CAST([3, 1, 2][CAST(rank % 3 AS INT) + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM g
), r AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM w
), c AS (
  SELECT *, first_value(CASE WHEN NOT cap < weight * rate THEN rate END IGNORE NULLS)
      OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce(weight * common, cap)) AS target FROM c
), q AS (
  SELECT doc_id, size, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id) AS BIGINT) AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT *, reached / nullif(target, 0) AS f1, (reached + source_size) / nullif(target, 0) AS f2 FROM q
), p AS (
  SELECT size, f1 AS v FROM f WHERE size > 0 UNION ALL SELECT size, f2 FROM f WHERE size > 0
), u AS (
  SELECT v, sum(size) OVER (ORDER BY v) AS upto FROM p WHERE v IS NOT NULL
), l AS (
  SELECT max(v) AS last FROM u WHERE upto <= CAST(1.5 AS DOUBLE) * (SELECT sum(size) FROM d)
)
SELECT doc_id, size, source_size, target,
       size * (CAST(coalesce(f1 <= last, FALSE) AS BIGINT) + CAST(coalesce(f2 <= last, FALSE) AS BIGINT)) AS taken
FROM f, l
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), m AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
)
SELECT x AS doc_id, coalesce(n, 0) AS n_shingles, component_id, x = component_id AS kept FROM m LEFT JOIN n ON doc_id = x
"""

OP9_SQL = r"""
WITH given AS (
  SELECT 0 AS side, doc_id AS id, md5(text) AS body, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l
  FROM (SELECT DISTINCT doc_id, text FROM documents)
  UNION ALL
  SELECT 1, CAST(item_id AS BIGINT), '', list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark
), src AS (
  SELECT *, r AS reading FROM given, (VALUES (0), (1)) n(r)
), w AS (
  SELECT side, id, body, reading, unnest(l) AS w, unnest(range(len(l))) AS k FROM src
), c AS (
  SELECT *, trim(w, {{STRIPPED}}) AS core, regexp_matches(rtrim(w, '"''”’)]'), '[.!?:]$') AS ends FROM w
), t AS (
  SELECT *, lower(core) AS low, left(core, 1) <> lower(left(core, 1)) AND core <> upper(core) AS capital,
         CASE WHEN regexp_matches(core, '^[-+]*[0-9]') OR lower(core) IN ({{NUMBERS}}) THEN 1 WHEN lower(core) IN ({{UNITS}}) THEN 2 ELSE 0 END AS first_kind FROM c
), n AS (
  SELECT *, CASE WHEN first_kind = 0 AND capital AND (reading = 1 OR NOT coalesce(lag(ends) OVER (PARTITION BY side, id, body, reading ORDER BY k), TRUE))
         THEN 3 ELSE first_kind END AS next_kind FROM t
), u AS (
  SELECT *, CASE WHEN next_kind = 2 AND coalesce(lag(next_kind) OVER (PARTITION BY side, id, body, reading ORDER BY k), 0) <> 1 THEN 0 ELSE next_kind END AS kind FROM n
), g AS (
  SELECT *, coalesce(lag(kind) OVER (PARTITION BY side, id, body, reading ORDER BY k), 0) AS before FROM u
), r AS (
  SELECT side, id, body, reading, list(CASE WHEN kind = 0 THEN low ELSE chr(1) || kind END ORDER BY k) AS tokens, list(kind ORDER BY k) AS kinds, list(low ORDER BY k) AS lows
  FROM g WHERE kind = 0 OR kind <> before GROUP BY side, id, body, reading
), i AS (
  SELECT *, unnest(range(len(tokens) - width + 1)) AS place FROM (SELECT *, least(5, len(tokens)) AS width FROM r WHERE side = 1)
), j AS (
  SELECT *, len(list_filter(kinds[place + 1:place + width], lambda x: x = 0)) >= least(2, width) AS enough FROM i
), k AS (
  SELECT *, enough OR NOT bool_or(enough) OVER (PARTITION BY id, reading) AS usable FROM j
), iw AS (
  SELECT id AS item_id, reading, width, place, tokens[place + 1:place + width] AS win,
         list_transform(list_filter(range(place + 1, place + width + 1), lambda x: kinds[x] > 0), lambda x: lows[x]) AS slots
  FROM k WHERE usable
), total AS (
  SELECT item_id, reading, count(*) AS n_windows FROM iw GROUP BY item_id, reading
), d AS (
  SELECT id AS doc_id, body, reading, width, kinds, lows, tokens, unnest(range(len(tokens) - width + 1)) AS at_
  FROM r, (SELECT DISTINCT width FROM iw) WHERE side = 0 AND len(tokens) >= width
), h AS (
  SELECT doc_id, body, item_id, d.reading, place, at_ - place AS diagonal, slots,
         list_transform(list_filter(range(at_ + 1, at_ + d.width + 1), lambda x: kinds[x] > 0), lambda x: lows[x]) AS doc_slots
  FROM d JOIN iw ON iw.reading = d.reading AND iw.width = d.width AND iw.win = tokens[at_ + 1:at_ + d.width]
), p AS (
  SELECT doc_id, body, item_id, reading, diagonal, count(DISTINCT a) < count(DISTINCT (a, b)) AS mixed
  FROM (SELECT doc_id, body, item_id, reading, diagonal, unnest(slots) AS a, unnest(doc_slots) AS b FROM h) GROUP BY doc_id, body, item_id, reading, diagonal
), f AS (
  SELECT h.doc_id, h.body, h.item_id, h.reading, count(DISTINCT place) AS matched, bool_and(slots = doc_slots) AS exact
  FROM h LEFT JOIN p ON h.doc_id IS NOT DISTINCT FROM p.doc_id AND h.body = p.body AND h.item_id = p.item_id AND h.reading = p.reading AND h.diagonal = p.diagonal
  WHERE NOT coalesce(mixed, FALSE) GROUP BY h.doc_id, h.body, h.item_id, h.reading
), x AS (
  SELECT doc_id, body, CAST(item_id AS BIGINT) AS item_id, n_windows, matched, CAST(matched AS DOUBLE) / n_windows AS share, exact,
         row_number() OVER (PARTITION BY doc_id, body, item_id ORDER BY CAST(matched AS DOUBLE) / n_windows DESC, f.reading) AS best
  FROM f JOIN total USING (item_id, reading) WHERE CAST(matched AS DOUBLE) / n_windows >= 0.8
)
SELECT DISTINCT doc_id, item_id, n_windows, matched, share, exact FROM x WHERE best = 1
"""
OP9_SQL = OP9_SQL.replace("{{STRIPPED}}", "'" + templates.STRIPPED.replace("'", "''") + "'")
OP9_SQL = OP9_SQL.replace("{{UNITS}}", ", ".join(f"'{u}'" for u in sorted(templates.UNITS)))
OP9_SQL = OP9_SQL.replace("{{NUMBERS}}", ", ".join(f"'{u}'" for u in sorted(templates.NUMBERS)))

OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95 * sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (
  SELECT x, min(y) AS component_id FROM r GROUP BY x
), n AS (
  SELECT x, count(*) AS n_links FROM l GROUP BY x
)
SELECT c.x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON c.x = n.x
"""

OP6_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(coalesce(lower(url), ''),
      '://ads\.|[./-]casino[./-]|/(wp-)?login\.(php|aspx)|[?&]redirect=https?%3a|/calendar/[0-9]{4}/[0-9]{2}/')
      THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def _nodes(leaves: tuple[shard_tree.Leaf, ...]) -> str:
    return ", ".join(f"({i}, '{parent}', '{path}', {w}::DOUBLE)" for i, level in enumerate(shard_tree.levels(leaves)) for parent, children in level.items() for path, w in children.items())


def _descent(name: str, leaves: tuple[shard_tree.Leaf, ...]) -> str:
    """CTEs that end in `name` (key, path): each level takes the child with the least score."""
    score = "-ln((CAST('0x' || md5(key || '@' || n.path)[1:13] AS BIGINT) + 0.5::DOUBLE) / 4503599627370496) / weight"
    steps = [f"{name}_n(level, parent, path, weight) AS (VALUES {_nodes(leaves)})", f"{name}_0 AS (SELECT DISTINCT key, '' AS path FROM d)"]
    for i in range(3):
        steps.append(f"{name}_{i + 1} AS (SELECT key, arg_min(n.path, {score}) AS path FROM {name}_{i} AS k JOIN {name}_n AS n ON n.level = {i} AND n.parent = k.path GROUP BY key)")
    return ",\n".join([*steps, f"{name} AS (SELECT key, CAST(string_split(path, '/')[3] AS INT) AS shard FROM {name}_3)"])


OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT b, CAST(b AS BIGINT) AS c, 0 AS i FROM range(256) AS t(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM k WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY b) AS t FROM k WHERE i = 8
), d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), b AS (
  SELECT doc_id, key, n + 1 AS size, list_transform(range(n), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i + 2, 1)) - 1) AS l FROM d
), s AS (
  SELECT doc_id, key, CAST(size AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), l), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM b, crc
), {_descent('now', shard_tree.tree_of(8))}, {_descent('grown', shard_tree.tree_of(9))}, o AS (
  SELECT s.*, now.shard, grown.shard AS grown_shard, (row_number() OVER (PARTITION BY s.doc_id, size, text_crc32) - 1) // {shard_tree.ALIKE_ROWS} AS lot FROM s JOIN now USING (key) JOIN grown USING (key)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
       row_number() OVER (PARTITION BY shard ORDER BY md5(key || ':' || text_crc32 || ':' || size || ':' || lot), doc_id NULLS FIRST, text_crc32, size, lot) - 1 AS slot
FROM o
"""


def _lloyd(rounds: int) -> str:
    near = "SELECT vec_id, p, min({'d': list_sum(list_transform(list_zip(parts.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 'e': e}) AS best FROM parts JOIN %s AS b USING (p) GROUP BY vec_id, p"
    steps = []
    for r in range(1, rounds + 1):
        steps += [
            f"a{r} AS MATERIALIZED ({near % f'b{r - 1}'})",
            f"m{r} AS (SELECT p, best.e AS e, k, sum(x[k])::BIGINT AS s, count(*) AS n FROM parts JOIN a{r} USING (vec_id, p), (SELECT unnest(range(1, len(x) + 1)) AS k FROM b0 WHERE p = 0 AND e = 0) GROUP BY p, best.e, k)",
            f"n{r} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY k) AS x FROM m{r} GROUP BY p, e)",
            f"b{r} AS MATERIALIZED (SELECT p, e, coalesce(n.x, b.x) AS x FROM b{r - 1} AS b LEFT JOIN n{r} AS n USING (p, e))",
        ]
    return ",\n".join([*steps, f"final AS MATERIALIZED ({near % f'b{rounds}'})"])


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(4096 * x) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // 8) + 1:(p + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(p)
), b0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 16
), {_lloyd(6)}, c AS (
  SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM final GROUP BY vec_id
), h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b6
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN kept USING (vec_id), h
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_token_files": op3_token_files,
    "op4_source_mix": op4_source_mix,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_url_filter": op6_url_filter,
    "op7_token_counts": op7_token_counts,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_shard_tree": op11_shard_tree,
    "op12_tandem_runs": op12_tandem_runs,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE: dict[str, str] = {
    "op4_source_mix": OP4_SQL,
    "op6_url_filter": OP6_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op11_shard_tree": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}

"""The operators over the test tables, and the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import collocations, decontaminate, language_id, license_scan, line_dedup, lm_scoring, mixing, near_dedup, quality, secret_scan, sharding, spelling, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
WITH base AS (
  SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}
), rows AS (
  SELECT doc_id, source, size::BIGINT AS size,
    -ln((('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / CASE WHEN length(text) / greatest(size, 1) BETWEEN 3 AND 13 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS ord
  FROM base
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM rows GROUP BY source
), caps AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST) AS turn FROM sizes
), levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size::DOUBLE) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps
), final AS (
  SELECT arg_min(level, turn) AS level FROM levels WHERE level * w < cap
), targets AS (
  SELECT source, source_size, CASE WHEN final.level IS NULL THEN cap ELSE least(cap, final.level * w) END AS target FROM levels LEFT JOIN final ON true
), plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets
), placed AS (
  SELECT r.*, p.source_size, p.target, p.epochs, round(p.target)::BIGINT - p.epochs * p.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM rows r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source
), mixed AS (
  SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, rest - earlier)))::BIGINT AS taken,
    CASE WHEN size > 0 THEN epochs + (greatest(0, least(size, rest - earlier)) > 0)::INT ELSE 0 END::BIGINT AS copies
  FROM placed
)
"""


@query("op5_source_mix", MIX_SQL.format(docs="documents") + "SELECT * FROM mixed")
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1 in turn and 150 % of all words."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def edit_sql(before: str, after: str, shards: int) -> str:
    """One edit of a slot map: CTEs that end in ``after`` (virtual_slot, shard)."""
    return f"""{after}_held AS (
  SELECT virtual_slot, shard, bytes, sum(bytes) OVER () / {shards} AS mean,
    sum(bytes) OVER (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) AS held FROM {before} JOIN loads USING (virtual_slot)
), {after}_marked AS (
  SELECT *, held - bytes / 2 <= mean OR bytes = 0 AS stays FROM {after}_held
), {after}_gaps AS (
  SELECT shard, sum(gap) OVER (ORDER BY shard) - gap AS place, sum(gap) OVER () AS total FROM (
    SELECT s AS shard, greatest(0.0::DOUBLE, (SELECT max(mean) FROM {after}_held) - coalesce(sum(bytes) FILTER (stays), 0)) AS gap
    FROM range({shards}) AS r(s) LEFT JOIN {after}_marked ON shard = s GROUP BY s) WHERE gap > 0
), {after}_line AS (
  SELECT virtual_slot, NULL::INT AS new_shard, (sum(bytes) OVER (ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) - bytes / 2) / sum(bytes) OVER () AS share
  FROM {after}_marked WHERE NOT stays
  UNION ALL SELECT NULL, shard, place / total FROM {after}_gaps
), {after}_dealt AS (
  SELECT virtual_slot, last_value(new_shard IGNORE NULLS) OVER (ORDER BY share, new_shard NULLS LAST) AS new_shard FROM {after}_line
), {after} AS (
  SELECT m.virtual_slot, coalesce(new_shard, shard)::INT AS shard FROM {after}_marked m LEFT JOIN {after}_dealt d ON m.virtual_slot = d.virtual_slot
)"""


SHARDS_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS r, 0 AS k FROM range(256) AS x(i)
  UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(r ORDER BY i) AS tab FROM bits WHERE k = 8
), coded AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, text IS NULL AS no_text,
    string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:octet_length(encode(text))] AS codes FROM documents
), records AS (
  SELECT doc_id, size, CASE WHEN NOT no_text THEN xor(list_reduce(list_prepend(4294967295, list_transform(codes, lambda h: ('0x' || h)::BIGINT)),
      lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1])), 4294967295) END::BIGINT AS text_crc32,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT % 4096)::INT AS virtual_slot FROM coded, crc
), loads AS (
  SELECT s::INT AS virtual_slot, coalesce(sum(size), 0)::BIGINT AS bytes, count(size) AS rows FROM range(4096) AS r(s) LEFT JOIN records ON virtual_slot = s GROUP BY s
), map1 AS (
  SELECT s::INT AS virtual_slot, (s % 24)::INT AS shard FROM range(4096) AS r(s)
), {edit_sql('map1', 'map2', 24)}, {edit_sql('map2', 'map3', 24)},
places AS (
  SELECT virtual_slot, shard, coalesce(sum(rows) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM map3 JOIN loads USING (virtual_slot) WHERE rows > 0
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (before + row_number() OVER (PARTITION BY virtual_slot ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1)::BIGINT AS slot,
  NULL::INT AS grown_shard, virtual_slot, 3::INT AS map_version
FROM records JOIN places USING (virtual_slot)
"""


@query("op10_shards", SHARDS_SQL)
def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM {docs}
), b AS (
  SELECT coalesce(item_id::VARCHAR, 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), bp AS (
  SELECT item, words, least(10, len(words)) AS n, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS i FROM b WHERE len(words) > 0
), bw AS (
  SELECT DISTINCT item, n, list_aggregate(words[i:i + n - 1], 'string_agg', ' ') AS win FROM bp
), lens AS (
  SELECT DISTINCT n FROM bw
), dp AS (
  SELECT rid, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, lens WHERE len(words) >= n
), dw AS (
  SELECT rid, n, i, list_aggregate(words[i:i + n - 1], 'string_agg', ' ') AS win FROM dp
), hits AS (
  SELECT rid, dw.n, i, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), places AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
), decon AS (
  SELECT d.rid, doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN places USING (rid) LEFT JOIN items USING (rid)
)
"""


@query("op2_decontamination", DECONTAMINATION_SQL.format(docs="documents") + "SELECT * EXCLUDE rid FROM decon")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words of every document against every benchmark item, windows of ten words."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    fields = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    return found.select("doc_id", *(F.col(f"contamination.{f}").alias(f) for f in fields))


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, and whether it is kept (1/2 or more)."""
    docs = table(spark, sf_dir, "documents")
    scored = quality.with_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "quality_score", (F.col("quality_score") >= 0.5).alias("keep"))


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.fit_languages(docs.where(~held_out))
    found = language_id.with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM scored
QUALIFY rank <= 10
"""


@query("op7_top_k", TOP_K_SQL)
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of every hundredth vector with all others."""
    vectors = vector_search.integer_vectors(table(spark, sf_dir, "embeddings"))
    return vector_search.top_inner_products(vectors, F.col("vec_id") % 100 == 0)


@query("op3_license_scan")
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document: how many places, the best covered license, its coverage and the places."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license_scan.*")


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every line of every document: lines within two edits."""
    return line_dedup.line_classes(table(spark, sf_dir, "documents"))


@query("op6_lm_scores")
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, learned from those whose remainder is not 0."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm_scoring.score_texts(table(spark, sf_dir, "documents"), held_out)


@query("op11_secrets")
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document: patterns, and strings that a compressor primed with the corpus' words cannot shorten."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(docs.select("doc_id", "text"), secret_scan.identifier_dictionary(docs))
    spans = F.col("secret_scan.spans")
    counts = [secret_scan.count_kind(spans, kind).alias(f"n_{kind}") for kind in secret_scan.KINDS]
    base = F.sha2(secret_scan.joined_spans(spans, secret_scan.KINDS[:3]).cast("binary"), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.joined_spans(spans, secret_scan.KINDS).alias("spans"))


SPELLING_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS r, 0 AS k FROM range(256) AS x(i)
  UNION ALL SELECT i, CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(r ORDER BY i) AS tab FROM bits WHERE k = 8
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lowered AS (
  SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, c, string_split(regexp_replace(hex(encode(doc || ':' || run)), '(..)', '\1,', 'g'), ',')[:octet_length(encode(doc || ':' || run))] AS codes FROM lowered
), hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(codes, lambda h: ('0x' || h)::BIGINT)),
      lambda acc, b: xor(acc >> 8, tab[(xor(acc, b) & 255) + 1])), 4294967295)::BIGINT AS h FROM coded, crc
), noisy AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM noisy WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), shorter AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, form, word AS at FROM forms UNION ALL SELECT s.word, f.form, f.word FROM steps s JOIN forms f ON f.word = s.form
)
SELECT f.word, f.n, f.n_near::BIGINT AS n_near, f.form, f.form_n, s.at AS root FROM forms f JOIN steps s ON f.word = s.word WHERE s.form IS NULL
"""


@query("op12_spelling", SPELLING_SQL)
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, with the form and the root of each."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


COLLOCATION_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM worded, range(1, 6) AS r(k) WHERE len(w) >= k
), counts AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100
), cuts AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, k - 1)) AS cut FROM counts WHERE k > 1
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ') JOIN totals t ON t.lang = c.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM counts c WHERE c.lang = b.lang AND c.k > len(string_split(b.phrase, ' ')) AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two to five words of each language, from all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))

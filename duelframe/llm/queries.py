"""One query per operator over the given tables, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}
TOKENIZER_FILES = {"words": "word_bpe_49k.json", "pieces": "piece_bpe_32k.model"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(kind: str) -> str:
    """Path of a public tokenizer file on this machine; executors have the same package."""
    return importlib.import_module("public_tokenizers").path(TOKENIZER_FILES[kind])


def register(name: str, sql: str | None = None):
    def add(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_SQL[name] = sql
        return function

    return add


@register("op9_token_planes")
def op9_token_planes(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.bitplanes import read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf, "documents"), tokenizer_path("words"), end_id=2)
    return read_token_files(manifest)


@register("op10_pieces")
def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from duelframe.llm.pieces import encode_texts

    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = encode_texts(docs, tokenizer_path("pieces"), round_trip_col="round_trip")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


@register("op5_language")
def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from duelframe.llm.langid import is_held_out, learn_profiles, predict_language

    docs = table(spark, sf, "documents")
    profiles = learn_profiles(docs.where(~is_held_out(F.col("doc_id"))))
    found = predict_language(docs, profiles)
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@register("op3_quality")
def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.quality import quality_scores

    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op2_kneser_ney")
def op2_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import functions as F

    from duelframe.llm.common import remainder
    from duelframe.llm.language_model import fit, score_texts

    docs = table(spark, sf, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 1
    scored = score_texts(docs, fit(docs.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), *scored.columns[1:])


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
spots AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
places AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM spots),
m AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM places p JOIN win ON p.s = win.s AND p.n = win.n),
hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS pos FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(hit.n_hit, 0)::BIGINT AS n_hit, coalesce(it.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(it.ks, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AND 20 * coalesce(hit.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


@register("op7_decontamination", OP7_SQL)
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.decontaminate import contamination, digest

    return digest(contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@register("op7_proximity")
def op7_proximity(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of op7_decontamination, which its SQL fixes, and the number of proximity matches."""
    from duelframe.llm.decontaminate import SLACK, contamination, digest

    return digest(contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), slack=SLACK))


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 80 * (na.n + nb.n - m)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, u.b FROM r JOIN u ON u.a = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""


@register("op4_near_duplicates", OP4_SQL)
def op4_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf, "documents"), n_words=2)


@register("op1_secrets")
def op1_secrets(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.secrets import digest, secret_spans

    return digest(secret_spans(table(spark, sf, "documents").select("doc_id", "text")))


@register("op6_syncmers")
def op6_syncmers(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.syncmers import edited_fingerprints

    return edited_fingerprints(table(spark, sf, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS x, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT doc_id, i, substring(x, 2 * i + 1, 100) AS g FROM (SELECT doc_id, x, unnest(generate_series(0, n - 50)) AS i FROM d WHERE n >= 50)),
m AS (SELECT hash(g) AS h, g, min(doc_id) AS least FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT s.doc_id, s.i FROM s JOIN m ON hash(s.g) = m.h AND s.g = m.g WHERE s.doc_id > m.least),
o AS (SELECT *, coalesce(i - lag(i) OVER w > 50, true)::INT AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM o),
p AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM r GROUP BY doc_id, span),
q AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM p),
k AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, string_agg(substring(x, 2 * was + 1, 2 * (a - was)), '' ORDER BY a) AS kept
  FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(k.n_removed, 0)::BIGINT AS n_removed, coalesce(k.n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.kept, '') || substring(d.x, 2 * coalesce(k.last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


@register("op8_repeats", OP8_SQL)
def op8_repeats(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf, "documents")).drop("kept_text")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (SELECT *, md5(concat_ws(':', '17', doc_id::VARCHAR, size::VARCHAR)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
c AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM s),
o AS (
  SELECT *, wanted - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
    sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w FROM c WHERE source_size > 0),
level AS (SELECT l, w FROM o WHERE cap * w > weight * l ORDER BY cap / weight, source LIMIT 1),
t AS (
  SELECT c.source, c.source_size, CASE WHEN c.source_size = 0 THEN 0.0 WHEN c.cap * level.w <= c.weight * level.l THEN c.cap ELSE level.l * c.weight / level.w END AS target
  FROM c LEFT JOIN level ON true),
r AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
p AS (
  SELECT k.*, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.words // r.source_size ELSE 0 END AS whole, CASE WHEN r.source_size > 0 THEN r.words % r.source_size ELSE 0 END AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key) AS upto, sum(k.size) OVER (PARTITION BY k.source, k.key) AS own, count(*) OVER (PARTITION BY k.source, k.key) AS n
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - own >= rest THEN 0 ELSE (rest - (upto - own)) // n END)::BIGINT AS taken
FROM p
"""


@register("op11_mixing", OP11_SQL)
def op11_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.common import saved
    from duelframe.llm.mixing import mix_plan, sized, taken

    rows = saved(sized(table(spark, sf, "documents")), "mix-sizes")
    found = taken(rows, mix_plan(rows, [5, 2, 1], share=1.5, max_epochs=2))
    return found.select(found["id"].alias("doc_id"), "size", "source_size", "target", "taken")


OP12_SQL = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
i AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
u AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM c),
s AS (
  SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * u.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1 : cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[cut + 1 : u.k], ' ')
  JOIN n ON n.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM s),
q AS (
  SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE o = 1 AND NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = b.lang AND len(c.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * c.a >= 100 * b.a))
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q WHERE rank <= 2000
"""


@register("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    from duelframe.llm.collocations import collocations

    return collocations(table(spark, sf, "documents"), min_count=100, max_words=5, top=2_000)


@register("op13_runs")
def op13_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every text, after the words of one document in ten have been replaced by repetitions of some of its own."""
    from pyspark.sql import functions as F

    from duelframe.llm.mixing import n_words
    from duelframe.llm.periodic import periodic_runs

    docs = table(spark, sf, "documents").select("doc_id", "text")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumn("__h", h).withColumn("__n", F.when(F.col("__h") % 10 == 0, n_words(F.col("text"))))
    g = F.floor(F.col("__h") / 10)
    docs = docs.withColumn("__a", F.when(F.col("__n") > 0, F.pmod(g, F.col("__n"))))
    docs = docs.withColumn("__p", 1 + F.floor((F.col("__n") - F.col("__a")) / (3 + F.pmod(g, F.lit(8)))))
    found = periodic_runs(docs.select("doc_id", "text", "__a", "__p"), overlay=("__a", "__p"))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        F.expr("(1000 * length) div period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

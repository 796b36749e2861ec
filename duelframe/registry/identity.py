"""Names and ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from duelframe import fixed_values as fv
from duelframe.functions.text import class_label, display_label, id_key, name_key, simple_name_key
from duelframe.functions.values import iso_date
from duelframe.operators import identity as i
from duelframe.operators import suggest
from duelframe.operators.serving import redact_ids
from duelframe.registry import fixtures as fx
from duelframe.registry.base import query, table

# sharp s is the one letter of these texts whose folded form is not its lower case
FOLDED = "lower(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'))"
SPACES = "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F ]+"


@query(
    "i01_name_key",
    f"SELECT doc_id, trim(regexp_replace(strip_accents({FOLDED.format(x='text')}), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM documents",
)
def name_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", name_key("text").alias("name_key"))


@query("i02_simple_name_key", f"SELECT doc_id, trim(regexp_replace({FOLDED.format(x='text')}, '{SPACES}', ' ', 'g')) AS name_key FROM documents")
def simple_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", simple_name_key("text").alias("name_key"))


@query(
    "i03_id_key",
    """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '//' WHEN 1 THEN ' http://h/' || upper(substr(md5(url), 1, 16)) || '/ ' ELSE upper(md5(url)) END AS raw FROM pages),
    s AS (SELECT page_id, regexp_extract(regexp_replace(trim(raw), '/+$', ''), '[^/]*$') AS last FROM u)
    SELECT page_id, CASE WHEN regexp_full_match(last, '[0-9a-fA-F]{16}') THEN lower(last) ELSE last END AS id FROM s""",
)
def id_keys(spark, sf):
    kind = F.col("page_id") % 3
    raw = (
        F.when(kind == 0, F.concat("url", F.lit("//")))
        .when(kind == 1, F.concat(F.lit(" http://h/"), F.upper(F.substring(F.md5("url"), 1, 16)), F.lit("/ ")))
        .otherwise(F.upper(F.md5("url")))
    )
    return table(spark, sf, "pages").select("page_id", id_key(raw).alias("id"))


@query(
    "i04_iso_date",
    """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, ' %Y-%m-%dT10:00:00') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_full_match(substr(trim(raw), 1, 10), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(trim(raw), 1, 10) AS DATE) END AS day FROM t""",
)
def iso_dates(spark, sf):
    kind = F.col("o_orderkey") % 4
    raw = (
        F.when(kind == 0, F.date_format("o_orderdate", "' 'yyyy-MM-dd'T10:00:00'"))
        .when(kind == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .when(kind == 2, "")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    return table(spark, sf, "orders").select("o_orderkey", iso_date(raw).alias("day"))


# Entities with unique names (suppliers) and with heavily shared names (parts).
ENTITIES_SQL = """
entities AS (
  SELECT 'S' || s_suppkey AS entity_id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'The ' || s_name END AS display FROM supplier
  UNION ALL SELECT 'P' || p_partkey, p_name, NULL FROM part),
idx AS (
  SELECT DISTINCT trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name_key, entity_id FROM (
    SELECT entity_id, name AS label FROM entities UNION ALL SELECT entity_id, coalesce(nullif(trim(display), ''), name) FROM entities)
  WHERE trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) <> '')
"""


def entities(spark, sf):
    key = F.col("s_suppkey")
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), key.cast("string")).alias("entity_id"),
        F.col("s_name").alias("name"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("The "), "s_name")).alias("display"),
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("display")
    )
    return suppliers.unionByName(parts)


def _index(spark, sf):
    return i.search_index(entities(spark, sf), entity_id="entity_id", name="name", display_name="display")


@query("i05_search_index", f"WITH {ENTITIES_SQL} SELECT name_key, entity_id FROM idx")
def search_index(spark, sf):
    return _index(spark, sf)


# Queries: names in another spelling, ids, damaged names and blanks.
ASKED_SQL = """
asked AS (
  SELECT DISTINCT CASE n % 5 WHEN 0 THEN upper(replace(name, ' ', '-')) WHEN 1 THEN entity_id || '/' WHEN 2 THEN name || 'zz' WHEN 3 THEN ' the ' || name ELSE name END AS query
  FROM (SELECT name, entity_id, CAST(substr(entity_id, 2) AS BIGINT) AS n FROM entities) UNION SELECT '  ')
"""
LOOKUP_SQL = f"""{ENTITIES_SQL}, {ASKED_SQL},
ids AS (SELECT DISTINCT entity_id FROM entities),
keys AS (SELECT name_key, COUNT(*) AS n, MIN(entity_id) AS one FROM idx GROUP BY 1),
k AS (SELECT query, regexp_extract(regexp_replace(trim(query), '/+$', ''), '[^/]*$') AS pid, trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM asked),
looked AS (
  SELECT query, CASE WHEN ids.entity_id IS NOT NULL THEN pid ELSE k.name_key END AS normalized_query,
    CASE WHEN trim(query) = '' THEN 'invalid' WHEN ids.entity_id IS NOT NULL OR keys.n = 1 THEN 'resolved' WHEN keys.n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
    coalesce(ids.entity_id, CASE WHEN keys.n = 1 THEN keys.one END) AS entity_id,
    CASE WHEN ids.entity_id IS NOT NULL THEN 1 ELSE coalesce(keys.n, 0) END AS candidates
  FROM k LEFT JOIN ids ON k.pid = ids.entity_id LEFT JOIN keys ON k.name_key = keys.name_key)
"""


def asked(spark, sf):
    n = F.substring("entity_id", 2, 30).cast("bigint") % 5
    text = (
        F.when(n == 0, F.upper(F.replace("name", F.lit(" "), F.lit("-"))))
        .when(n == 1, F.concat("entity_id", F.lit("/")))
        .when(n == 2, F.concat("name", F.lit("zz")))
        .when(n == 3, F.concat(F.lit(" the "), "name"))
        .otherwise(F.col("name"))
    )
    blank = spark.range(1).select(F.lit("  ").alias("query"))
    return entities(spark, sf).select(text.alias("query")).unionByName(blank).distinct()


def _looked(spark, sf):
    return i.lookup(asked(spark, sf), _index(spark, sf), i.entity_ids(entities(spark, sf), "entity_id"))


@query("i07_lookup", f"WITH {LOOKUP_SQL} SELECT * FROM looked")
def lookup(spark, sf):
    return _looked(spark, sf)


@query(
    "i07_lookup_candidates",
    f"""WITH {LOOKUP_SQL} SELECT query, entity_id FROM looked WHERE status = 'resolved'
    UNION ALL SELECT query, idx.entity_id FROM looked JOIN idx ON normalized_query = name_key WHERE status = 'ambiguous'""",
)
def candidates(spark, sf):
    return i.lookup_candidates(_looked(spark, sf), _index(spark, sf))


ALIAS_SQL = """
aliases AS (SELECT n_name AS alias, 'S' || s_suppkey AS target FROM nation JOIN supplier ON n_nationkey = s_nationkey
  UNION ALL SELECT '--', 'S1' UNION ALL SELECT n_name, 'S-none' FROM nation WHERE n_nationkey < 3)
"""


def aliases(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    target = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("target")
    named = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("alias"), target)
    empty = spark.range(1).select(F.lit("--").alias("alias"), F.lit("S1").alias("target"))
    unknown = nation.where("n_nationkey < 3").select(F.col("n_name").alias("alias"), F.lit("S-none").alias("target"))
    return named.unionByName(empty).unionByName(unknown)


@query(
    "i06_alias_index",
    f"""WITH {ENTITIES_SQL}, {ALIAS_SQL} SELECT name_key, entity_id FROM idx UNION
    SELECT trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')), target FROM aliases
    WHERE target IN (SELECT entity_id FROM entities) AND trim(regexp_replace(lower(alias), '[^a-z0-9]+', ' ', 'g')) <> ''""",
)
def alias_index(spark, sf):
    return i.add_aliases(_index(spark, sf), aliases(spark, sf), i.entity_ids(entities(spark, sf), "entity_id"))


@query(
    "i06_alias_findings",
    f"""WITH {ENTITIES_SQL}, {ALIAS_SQL} SELECT alias, target AS entity_id, 'empty_alias' AS finding FROM aliases WHERE alias = '--'
    UNION ALL SELECT alias, target, 'unknown_target' FROM aliases WHERE target NOT IN (SELECT entity_id FROM entities)""",
)
def alias_findings(spark, sf):
    return i.alias_findings(aliases(spark, sf), i.entity_ids(entities(spark, sf), "entity_id"))


@query("i08_suggestions")
def suggestions(spark, sf):
    misses = _looked(spark, sf).where("status = 'not_found'").select(F.col("normalized_query").alias("name_key"))
    return suggest.suggestions(misses, _index(spark, sf))


@query(
    "i09_explicit_id",
    f"""WITH {LOOKUP_SQL},
    p AS (SELECT DISTINCT query, CASE WHEN length(query) % 3 = 0 THEN 'S' || (length(query) % 7) WHEN length(query) % 3 = 1 THEN 'P' || (unicode(upper(substr(trim(query), 2, 1))) % 50) END AS explicit_id FROM asked),
    j AS (SELECT p.query, p.explicit_id, l.status, l.entity_id AS found, l.candidates, ids.entity_id AS known,
        idx.entity_id AS named FROM p JOIN looked l ON p.query = l.query LEFT JOIN ids ON ids.entity_id = p.explicit_id
        LEFT JOIN idx ON idx.entity_id = p.explicit_id AND idx.name_key = trim(regexp_replace(lower(p.query), '[^a-z0-9]+', ' ', 'g'))),
    c AS (SELECT *, CASE WHEN status = 'invalid' THEN 'invalid_query'
        WHEN explicit_id IS NOT NULL AND known IS NULL THEN 'not_found'
        WHEN explicit_id IS NOT NULL AND status = 'ambiguous' AND named IS NULL THEN 'identity_mismatch'
        WHEN explicit_id IS NOT NULL AND status = 'resolved' AND found <> explicit_id THEN 'identity_mismatch'
        WHEN explicit_id IS NOT NULL THEN NULL
        WHEN status IN ('not_found', 'ambiguous') THEN status END AS error_code FROM j)
    SELECT query, explicit_id, status, candidates, error_code, CASE WHEN error_code IS NULL THEN coalesce(explicit_id, found) END AS entity_id FROM c""",
)
def explicit(spark, sf):
    length = F.length("query")
    second = F.ascii(F.upper(F.substring(F.trim("query"), 2, 1)))
    chosen = F.when(length % 3 == 0, F.concat(F.lit("S"), (length % 7).cast("string"))).when(
        length % 3 == 1, F.concat(F.lit("P"), (second % 50).cast("string"))
    )
    pairs = asked(spark, sf).withColumn("explicit_id", chosen)
    return i.resolve(pairs, _index(spark, sf), i.entity_ids(entities(spark, sf), "entity_id"), explicit_id="explicit_id")


@query(
    "i10_latest_record",
    f"""WITH {fx.SNAPSHOTS_SQL} SELECT CAST(entity_id AS VARCHAR) AS entity_id, 'user ' || entity_id AS entity_name, 'user ' || entity_id AS display_name,
      CASE WHEN entity_id % 2 = 0 THEN 'M_FLY' END AS context_class, dob, as_of FROM snaps
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY as_of DESC) = 1""",
)
def latest(spark, sf):
    user = F.concat(F.lit("user "), F.col("entity_id").cast("string"))
    snaps = fx.snapshots(spark, sf).withColumns(
        {"name": user, "display": F.lit(" "), "klass": F.when(F.col("entity_id") % 2 == 0, "M_FLY").otherwise("")}
    )
    names = fv.Columns(entity_id="entity_id", entity_name="name", display_name="display", last_class="klass", as_of="as_of", dob="dob")
    return i.latest_records(snaps, columns=names)


@query(
    "i11_simple_resolver",
    """WITH e AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier UNION ALL SELECT 'P' || p_partkey, p_name FROM part),
    idx AS (SELECT lower(name) AS k, COUNT(DISTINCT id) AS n, MIN(id) AS one FROM e GROUP BY 1),
    al AS (SELECT lower(n_name) AS k, MAX(CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'Supplier#00000000' || (n_nationkey % 10) END) AS d FROM nation GROUP BY 1),
    q AS (SELECT DISTINCT query FROM (SELECT n_name AS query FROM nation UNION ALL SELECT upper(s_name) FROM supplier UNION ALL SELECT ' ' || s_suppkey FROM supplier
       UNION ALL SELECT p_name FROM part UNION ALL SELECT c_name FROM customer)),
    j AS (SELECT query, trim(query) AS exact, d, coalesce(lower(d), lower(trim(query))) AS k FROM q LEFT JOIN al ON lower(trim(query)) = al.k),
    r AS (SELECT query, coalesce(a.id, b.id) AS direct, idx.n, idx.one FROM j LEFT JOIN (SELECT DISTINCT id FROM e) a ON j.exact = a.id LEFT JOIN (SELECT DISTINCT id FROM e) b ON j.d = b.id LEFT JOIN idx ON j.k = idx.k)
    SELECT query, coalesce(direct, CASE WHEN n = 1 THEN one END) AS entity_id, CASE WHEN direct IS NOT NULL THEN NULL WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' END AS error_code FROM r""",
)
def simple_resolver(spark, sf):
    supplier, nation, part = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "part")
    e = supplier.select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")).unionByName(
        part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    )
    even = F.col("n_nationkey") % 2 == 0
    hop = F.when(even, F.col("n_nationkey").cast("string")).otherwise(F.concat(F.lit("Supplier#00000000"), (F.col("n_nationkey") % 10).cast("string")))
    alias_table = nation.select(F.col("n_name").alias("alias"), hop.alias("destination"))
    texts = [
        nation.select(F.col("n_name").alias("query")),
        supplier.select(F.upper("s_name").alias("query")),
        supplier.select(F.concat(F.lit(" "), F.col("s_suppkey").cast("string")).alias("query")),
        part.select(F.col("p_name").alias("query")),
        table(spark, sf, "customer").select(F.col("c_name").alias("query")),
    ]
    asked_all = texts[0]
    for more in texts[1:]:
        asked_all = asked_all.unionByName(more)
    return i.resolve_simple(asked_all, e, aliases=alias_table, entity_id="id", name="name", display_name=None)


@query(
    "i12_pair_resolution",
    f"""WITH {fx.REQUESTS_SQL} SELECT a_id = b_id AS same_entity, COUNT(*) AS n FROM requests GROUP BY 1""",
)
def pairs(spark, sf):
    return fx.requests(spark, sf).groupBy(i.same_entity("a_id", "b_id").alias("same_entity")).agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = """replace(replace(replace(replace(replace(replace(replace(lower(replace(replace(trim({x}), '_', ' '), 'ß', 'ss')), '''', ''), 'ufc ', ' '), ' interim ', ' '), ' title ', ' '),
    ' tournament ', ' '), ' superfight ', ' '), ' bout', ' ')"""


@query(
    "f01_class_label",
    f"""WITH t AS (SELECT doc_id, 'UFC ' || replace(text, ' ', CASE doc_id % 3 WHEN 0 THEN '_' WHEN 1 THEN ' title ' ELSE ' bout ' END) AS raw FROM documents)
    SELECT doc_id, trim(regexp_replace({CLASS_SQL.format(x="raw")}, '{SPACES}', ' ', 'g')) AS label FROM t""",
)
def class_labels(spark, sf):
    kind = F.col("doc_id") % 3
    joint = F.when(kind == 0, "_").when(kind == 1, " title ").otherwise(" bout ")
    raw = F.concat(F.lit("UFC "), F.replace(F.col("text"), F.lit(" "), joint))
    return table(spark, sf, "documents").select("doc_id", class_label(raw).alias("label"))


@query(
    "r16_redact_ids",
    """WITH m AS (SELECT page_id, 'No match for ' || substr(md5(url), 1, 16) || ' or ' || upper(substr(md5(url), 1, 16)) || ', see ' || substr(md5(html), 1, 13) || ' and abc123.' AS message FROM pages)
    SELECT page_id, 'No match for ' || name || ' or ' || name || ', see Unknown Fighter and abc123.' AS safe_message
    FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id ELSE 'Unknown Fighter' END AS name FROM pages)""",
)
def redact(spark, sf):
    pages = table(spark, sf, "pages")
    token = F.substring(F.md5("url"), 1, 16)
    message = F.concat(
        F.lit("No match for "), token, F.lit(" or "), F.upper(token), F.lit(", see "), F.substring(F.md5("html"), 1, 13), F.lit(" and abc123.")
    )
    # pages may share a url and so an id: each page knows its own name only
    names = pages.where("page_id % 2 = 0").select("page_id", token.alias("entity_id"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("display_name"))
    out = redact_ids(pages.select("page_id", message.alias("message")), names, key="page_id", message="message", own_names=True)
    return out.select("page_id", "safe_message")


LABEL_CODES = ["m_light", "Open Stance", "no-contest", "KO/TKO", "main fight_night", "Catch weight bout", "Middle Bout", "", "stale"]


@query(
    "r20_display_labels",
    f"""WITH c AS (SELECT p_partkey, list_element({LABEL_CODES!r}, CAST(p_partkey % {len(LABEL_CODES)} + 1 AS INT)) AS code FROM part)
    SELECT p_partkey, list_element(['Male Lightweight', 'Open stance', 'No contest', 'KO/TKO', 'Main Fight Night', 'Catchweight', 'Middle', 'Unknown', 'Stale fighter data'], CAST(p_partkey % {len(LABEL_CODES)} + 1 AS INT)) AS label FROM c""",
)
def labels(spark, sf):
    codes = F.array(*[F.lit(c) for c in LABEL_CODES])
    code = F.element_at(codes, (F.col("p_partkey") % len(LABEL_CODES) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", display_label(code, "weight_class").alias("label"))

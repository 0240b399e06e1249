"""Registered queries over the sample tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import aggregates, aliases, conflicts, discovery, dml, facts as fa, graph, grounding, reconcile, search, vectors
from . import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _fact_sql() -> str:
    parts = []
    for kind, (code, prefix, key, columns, refs) in bridge.TYPES.items():
        for i, (p, x) in enumerate(columns.items()):
            x = x.replace("string)", "varchar)")
            number = x.startswith("cast(") or x == "p_size"
            obj = f"coalesce(cast({x} AS varchar), 'null')" if number else f"coalesce(to_json({x})::VARCHAR, 'null')"
            parts.append(
                f"SELECT ({key}::BIGINT * 8 + {code}) * 8 + {i} AS id, concat('{prefix}', {key}) AS subject, '{'ref:' + refs[p] if p in refs else p}' AS predicate, "
                f"{obj} AS object_json, 'json' AS adapter, 1.0::DOUBLE AS confidence, {bridge.AT}::BIGINT AS observed_at FROM {bridge.TABLES[kind]}"
            )
    return " UNION ALL ".join(parts)


FACTS = f"facts AS ({_fact_sql()})"
ENTITIES = "entities AS (" + " UNION ALL ".join(f"SELECT concat('{p}', {k}) AS id, '{kind}' AS entity_type FROM {bridge.TABLES[kind]}" for kind, (_, p, k, _, _) in bridge.TYPES.items()) + ")"
BASE = f"WITH RECURSIVE {FACTS}, {ENTITIES}"
PLAIN = f"WITH {FACTS}, {ENTITIES}"
STR = "CASE WHEN object_json[1] = '\"' THEN object_json->>'$' END"
STRNUM = "CASE WHEN object_json[1] = '\"' THEN object_json->>'$' WHEN object_json[1] IN ('-','0','1','2','3','4','5','6','7','8','9') THEN object_json END"
VAL = "CASE WHEN object_json[1] = '\"' THEN object_json->>'$' WHEN object_json = 'null' THEN '' ELSE object_json END"
NORM = f"trim(regexp_replace(translate(lower({{}}), '{fx.ACCENTED}', '{fx.FOLDED}'), '\\s+', ' ', 'g'))"
LOOKS = (
    "(regexp_matches({0}, '[A-Za-z]') AND NOT contains({0}, '/') AND NOT (len(regexp_extract_all({0}, '[0-9]'))::FLOAT / len({0})::FLOAT > 0.7::FLOAT) "
    "AND NOT (len(regexp_extract_all({0}, '[0-9]')) >= 6 AND len(regexp_extract_all({0}, '[-:]')) >= 2))"
)
LOCAL = "CASE WHEN instr({0}, '@') > 1 AND (regexp_matches(split_part({0}, '@', 1), '[._-]') OR strlen(split_part({0}, '@', 1)) >= 4) THEN split_part({0}, '@', 1) END"
HUMAN = (
    "CASE WHEN regexp_matches({0}, '[._-]') AND len(list_filter(regexp_split_to_array({0}, '[._-]'), lambda p: regexp_matches(p, '[A-Za-z]'))) >= 2 THEN "
    "array_to_string(list_transform(list_filter(regexp_split_to_array({0}, '[._-]'), lambda p: regexp_matches(p, '[A-Za-z]')), lambda p: upper(p[1]) || lower(p[2:])), ' ') END"
)
STATS = f"""vals AS (SELECT f.id, f.subject, e.entity_type, f.predicate, trim({STRNUM}) AS v FROM facts f JOIN entities e ON e.id = f.subject WHERE f.predicate NOT LIKE 'ref:%'),
stats AS (SELECT entity_type, predicate, count(*) AS total, count(DISTINCT v) AS uniq, sum(len(v)) / count(*) AS avg_len,
  count(DISTINCT v) FILTER (WHERE v IN (SELECT id FROM entities)) AS fk_hits FROM vals WHERE v <> '' GROUP BY 1, 2),
fields AS (SELECT entity_type, predicate FROM stats WHERE total >= 2 AND uniq::FLOAT / total::FLOAT >= 0.8::FLOAT AND avg_len BETWEEN 3 AND 60 AND fk_hits::FLOAT / uniq::FLOAT <= 0.3::FLOAT)"""
ALIASES = f"""{STATS},
raw AS (SELECT id AS entity_id, id AS alias, 'id' AS source, 1.0 AS confidence, -1 AS fid, 0 AS rank FROM entities
  UNION ALL SELECT subject, v, 'field:' || predicate, 1.0, id, 0 FROM vals SEMI JOIN fields USING (entity_type, predicate) WHERE v <> ''
  UNION ALL SELECT subject, {HUMAN.format(f'({LOCAL.format("v")})')}, 'email_local', 0.7, id, 1 FROM vals SEMI JOIN fields USING (entity_type, predicate) WHERE v <> ''
  UNION ALL SELECT subject, {LOCAL.format("v")}, 'email_local', 0.9, id, 2 FROM vals SEMI JOIN fields USING (entity_type, predicate) WHERE v <> ''),
normed AS (SELECT *, {NORM.format("alias")} AS alias_norm FROM raw WHERE alias IS NOT NULL),
aliases AS (SELECT entity_id, alias, alias_norm, source, confidence::DOUBLE AS confidence FROM normed
  WHERE strlen(alias_norm) >= 2 AND (source = 'id' OR {LOOKS.format("alias_norm")})
  QUALIFY row_number() OVER (PARTITION BY entity_id, alias_norm ORDER BY fid, rank) = 1)"""
EDGES = f"edges AS (SELECT DISTINCT subject AS src, {STR} AS dst FROM facts WHERE predicate LIKE 'ref:%' AND subject IN (SELECT id FROM entities) AND {STR} IN (SELECT id FROM entities))"
VALUES = f"strs AS (SELECT f.id, f.subject, f.predicate, trim({STR}) AS v FROM facts f JOIN entities e ON e.id = f.subject WHERE f.predicate NOT LIKE 'ref:%' AND trim({STR}) <> '')"
WHOLE = f"""{VALUES}, hits AS (SELECT s.id, s.subject, s.predicate, a.entity_id, e.entity_type, a.confidence FROM strs s JOIN aliases a ON a.alias_norm = {NORM.format("s.v")}
  JOIN entities e ON e.id = a.entity_id WHERE len(s.v) < 60 AND strlen({NORM.format("s.v")}) >= 2 AND a.entity_id <> s.subject),
per AS (SELECT id, subject, predicate, entity_type, count(*) AS n, min(entity_id) AS target, min(confidence) AS c FROM hits GROUP BY ALL),
won AS (SELECT id, subject, predicate, count(*) FILTER (WHERE n = 1) AS winners, min(entity_type) FILTER (WHERE n = 1) AS t, min(target) FILTER (WHERE n = 1) AS target, min(c) FILTER (WHERE n = 1) AS c FROM per GROUP BY ALL)"""
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9''-]+'), lambda t: t <> '')"
GRAMS = (
    f"toks AS (SELECT id, subject, predicate, {TOKENS.format('v')} AS t FROM strs WHERE len(v) >= 60), "
    "grams AS (SELECT id, subject, predicate, n, pos, array_to_string(t[pos:pos + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS pos FROM toks, range(1, 6) r(n) WHERE len(t) >= n)), "
    "sole AS (SELECT alias_norm, min(entity_id) AS entity_id, min(e.entity_type) AS entity_type, min(confidence) AS confidence FROM aliases a JOIN entities e ON e.id = a.entity_id GROUP BY 1 HAVING count(*) = 1 AND min(confidence) >= 0.9 AND len(alias_norm) >= 5), "
    f"mentions AS (SELECT g.id, g.subject, g.predicate, s.entity_id, s.entity_type, s.confidence FROM grams g JOIN sole s ON s.alias_norm = {NORM.format('g.gram')} WHERE s.entity_id <> g.subject "
    "QUALIFY row_number() OVER (PARTITION BY g.id, s.entity_type, s.entity_id ORDER BY g.n DESC, g.pos) = 1)"
)
DISPUTED = """num AS (SELECT *, regexp_extract(subject, '([0-9]+)$', 1)::BIGINT AS num FROM facts),
disputed AS (SELECT id, subject, predicate, object_json, adapter, confidence, observed_at FROM facts
  UNION ALL SELECT -id - 1, subject, predicate, '"DISPUTED"', CASE num % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'csv' ELSE 'txt' END, CASE WHEN num % 2 = 0 THEN 0.9 ELSE 0.5 END, observed_at + num % 5 - 2
  FROM num WHERE predicate IN ('segment', 'status') AND num % 7 = 0)"""
CONFLICTS = f"""{DISPUTED}, scalar AS (SELECT * FROM disputed WHERE (predicate = 'segment' AND subject LIKE 'CUST-%') OR (predicate = 'status' AND subject LIKE 'ORD-%')),
unlike AS (SELECT subject, predicate FROM scalar GROUP BY ALL HAVING min(object_json) <> max(object_json)), open AS (SELECT * FROM scalar SEMI JOIN unlike USING (subject, predicate)),
conflicts AS (SELECT a.subject, a.predicate, a.id AS fact_a_id, b.id AS fact_b_id FROM open a JOIN open b USING (subject, predicate) WHERE a.id < b.id AND a.object_json <> b.object_json)"""


def _f(s, d):
    return bridge.facts(s, d)


def _e(s, d):
    return bridge.entities(s, d)


def _a(s, d):
    return aliases.derive_aliases(_f(s, d), _e(s, d))


def _scalar(s):
    return s.createDataFrame([("segment", "customers", "scalar"), ("status", "orders", "scalar"), ("brand", "parts", "list")], "predicate string, entity_type string, cardinality string")


@query("top_referenced_customers", f"{BASE}, {ALIASES}, top AS (SELECT object_json, count(*) AS n FROM facts WHERE predicate = 'ref:customers' GROUP BY 1 ORDER BY n DESC, object_json LIMIT 20), lab AS (SELECT entity_id, arg_min(alias, alias) AS label FROM aliases WHERE source LIKE 'field:%' GROUP BY 1) SELECT object_json->>'$' AS id, n, label FROM top JOIN lab ON lab.entity_id = object_json->>'$'")
def top_referenced_customers(s, d):
    """Flagship: the customers that orders refer to most, with their labels."""
    f = bridge.facts(s, d, ["customers", "orders"])
    top = aggregates.top_values(f, "ref:customers", 20).select(fx.unquote(F.col("object_json")).alias("id"), "n")
    e = bridge.entities(s, d, ["customers", "orders"])
    # Which fields name customers is told by all of them; only the top ones' aliases are derived.
    names = aliases.alias_fields(aliases.alias_field_stats(bridge.facts(s, d, ["customers"]), bridge.entities(s, d)))
    cust = e.where("entity_type = 'customers'").join(F.broadcast(top.select("id")), "id", "left_semi")
    own = bridge.facts(s, d, ["customers"]).join(F.broadcast(top.select(F.col("id").alias("subject"))), "subject", "left_semi")
    return F.broadcast(top).join(aliases.entity_labels(cust, aliases.derive_aliases(own, cust, fields=names)), "id")


@query("emit_facts", f"{BASE} SELECT * FROM facts")
def q_emit(s, d):
    return _f(s, d).drop("document_id", "locator")


query("emit_entities", f"{BASE} SELECT * FROM entities")(_e)
query("entity_counts", f"{BASE} SELECT entity_type, count(*) AS n FROM entities GROUP BY 1")(lambda s, d: aggregates.entity_counts(_e(s, d)))
query("predicate_counts", f"{BASE} SELECT predicate, count(*) AS n FROM facts GROUP BY 1")(lambda s, d: aggregates.predicate_counts(_f(s, d), _e(s, d)))
query("predicate_counts_of_type", f"{BASE} SELECT predicate, count(*) AS n FROM facts WHERE subject LIKE 'CUST-%' GROUP BY 1")(lambda s, d: aggregates.predicate_counts(_f(s, d), _e(s, d), "customers"))
query("top_values", f"{BASE} SELECT object_json, count(*) AS n FROM facts WHERE predicate = 'ref:customers' GROUP BY 1 ORDER BY n DESC, object_json LIMIT 20")(lambda s, d: aggregates.top_values(_f(s, d), "ref:customers"))
query("count_with_object", f"{BASE} SELECT count(*) AS n FROM facts WHERE predicate = 'segment' AND object_json IN ('\"BUILDING\"', 'BUILDING')")(lambda s, d: aggregates.count_with_object(_f(s, d), "segment", "BUILDING"))
query("source_counts", f"{BASE}, {DISPUTED} SELECT subject, count(DISTINCT adapter) AS source_count FROM disputed GROUP BY 1")(lambda s, d: aggregates.source_counts(bridge.disputed(_f(s, d))))
query("summary", f"{BASE}, {ALIASES} SELECT 'facts' AS name, count(*) AS n FROM facts UNION ALL SELECT 'entities', count(*) FROM entities UNION ALL SELECT 'aliases', count(*) FROM aliases")(lambda s, d: aggregates.summary(facts=_f(s, d), entities=_e(s, d), aliases=_a(s, d)))
query("facts_for_subject", f"{BASE} SELECT id, predicate, object_json FROM facts WHERE subject = 'CUST-7'")(lambda s, d: fa.facts_for_subject(_f(s, d), "CUST-7").select("id", "predicate", "object_json"))
query("ref_facts", f"{BASE} SELECT subject, predicate, object_json FROM facts WHERE predicate LIKE 'ref:%'")(lambda s, d: fa.ref_facts(_f(s, d)))
query("entity_page", f"{BASE} SELECT id FROM entities WHERE entity_type = 'customers' AND id LIKE '%1%' ORDER BY id LIMIT 50 OFFSET 10")(lambda s, d: dml.entity_page(_e(s, d), "customers", "1", 10, 50))


@query("discover_id", "SELECT * FROM (VALUES ('customer', NULL), ('events', 'event_id'), ('documents', 'doc_id'), ('embeddings', 'vec_id'), ('pages', 'page_id'), ('benchmark', 'item_id'), ('labels', 'doc_id'), ('conversations', NULL), ('region', NULL)) v(table_name, id_column)")
def q_ids(s, d):
    names = ["customer", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations", "region"]
    return s.createDataFrame([(n, discovery.discover_id(s.read.parquet(f"{d}/{n}.parquet"), n)) for n in names], "table_name string, id_column string")


@query("detect_fks", """SELECT "column", target, hits FROM (
  SELECT 'o_custkey' AS "column", 'customers' AS target, count(*) AS hits FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 20) WHERE o_custkey IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'nation', 'nations', count(*) FROM (SELECT o_orderkey % 30 AS n FROM orders ORDER BY o_orderkey LIMIT 20) WHERE n IN (SELECT n_nationkey FROM nation)) WHERE hits >= 10""")
def q_fks(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.concat(F.lit("C"), "o_custkey").alias("o_custkey"), F.concat(F.lit("N"), F.col("o_orderkey") % 30).alias("nation"), "o_orderstatus")
    c = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C"), "c_custkey").alias("id"))
    n = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("N"), "n_nationkey").alias("id"))
    return discovery.detect_fks(o, "orders", discovery.id_index({"customers": (c, "id"), "nations": (n, "id")}), "o_orderkey")


@query("long_text_fields", "SELECT field FROM (SELECT 'text' AS field, avg(CASE WHEN len(trim(text)) >= 200 THEN 1.0 ELSE 0 END) AS r FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'lang', avg(CASE WHEN len(trim(lang)) >= 200 THEN 1.0 ELSE 0 END) FROM documents) WHERE r >= 0.5")
def q_long(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return fa.long_text_fields(docs.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("text", "lang")])).alias("x")).select("x.*"))


@query("text_jobs", "SELECT doc_id::VARCHAR AS parent_subject, 'documents' AS parent_type, 'text' AS field, sha256(text) AS h, concat('doc_id=', doc_id, '/text') AS locator FROM documents WHERE len(trim(text)) >= 200")
def q_jobs(s, d):
    j = fa.text_jobs(s.read.parquet(f"{d}/documents.parquet"), "doc_id", "documents", ["text"])
    return j.select("parent_subject", "parent_type", "field", F.sha2("text", 256).alias("h"), "locator")


query("alias_field_stats", f"{BASE}, {STATS} SELECT entity_type, predicate, total::BIGINT AS total, uniq, round(avg_len, 6) AS avg_len, fk_hits FROM stats")(
    lambda s, d: aliases.alias_field_stats(_f(s, d), _e(s, d)).withColumn("avg_len", F.round("avg_len", 6)))
query("alias_fields", f"{BASE}, {STATS} SELECT * FROM fields")(lambda s, d: aliases.alias_fields(aliases.alias_field_stats(_f(s, d), _e(s, d))))
query("derive_aliases", f"{BASE}, {ALIASES} SELECT * FROM aliases")(_a)


@query("derive_aliases_blocked", f"{BASE}, {ALIASES} SELECT * FROM aliases WHERE NOT (alias_norm LIKE 'nation_1%' AND entity_id LIKE 'NAT-%')")
def q_blocked(s, d):
    block = s.createDataFrame([(f"nation_{i}", f"NAT-{i}") for i in range(25) if str(i)[0] == "1"], "alias_norm string, entity_id string")
    return aliases.derive_aliases(_f(s, d), _e(s, d), block)


@query("entity_labels", f"""{BASE}, {ALIASES}, best AS (SELECT entity_id, alias FROM aliases WHERE source <> 'id' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY (source LIKE 'field:%') DESC, confidence DESC, alias) = 1)
  SELECT e.id, coalesce(alias, e.id) AS label FROM entities e LEFT JOIN best b ON b.entity_id = e.id""")
def q_labels(s, d):
    return aliases.entity_labels(_e(s, d), _a(s, d))


@query("upsert_aliases", f"{BASE}, {ALIASES} SELECT entity_id, CASE WHEN source = 'id' THEN lower(alias) ELSE alias END AS alias, alias_norm, CASE WHEN source = 'id' THEN 'derived' ELSE source END AS source, confidence FROM aliases")
def q_upsert(s, d):
    a = _a(s, d)
    new = a.where("source = 'id'").select("entity_id", F.lower("alias").alias("alias"), "alias_norm", F.lit("derived").alias("source"), F.lit(0.5).alias("confidence"), F.lit(1).alias("seq"))
    return aliases.upsert_aliases(a, new)


@query("scalar_functions", f"SELECT c_custkey, {NORM.format('c_name')} AS norm, {LOOKS.format('c_name')} AS looks, {LOCAL.format('mail')} AS local, {HUMAN.format(LOCAL.format('mail').join(['(', ')']))} AS human, regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM (SELECT *, concat('team.customer', c_custkey, '@example.com') AS mail FROM customer)")
def q_scalars(s, d):
    c = s.read.parquet(f"{d}/customer.parquet").withColumn("mail", F.expr("concat('team.customer', c_custkey, '@example.com')"))
    local = fx.email_local(F.col("mail"))
    return c.select("c_custkey", fx.normalize_alias(F.col("c_name")).alias("norm"), fx.looks_like_alias(F.col("c_name")).alias("looks"), local.alias("local"), fx.humanize_email_local(local).alias("human"), fx.sanitize(F.col("c_name")).alias("safe"))


query("whole_value_refs", f"{BASE}, {ALIASES}, {WHOLE} SELECT id, subject, 'ref:' || t AS predicate, to_json(target)::VARCHAR AS object_json, (c::FLOAT * 0.9::FLOAT)::FLOAT::DOUBLE AS confidence FROM won WHERE winners = 1")(
    lambda s, d: reconcile.whole_value_refs(_f(s, d), _e(s, d), _a(s, d)).drop("locator"))
query("ambiguous_values", f"{BASE}, {ALIASES}, {WHOLE} SELECT id, subject, predicate FROM won WHERE winners <> 1")(
    lambda s, d: reconcile.ambiguous_values(_f(s, d), _e(s, d), _a(s, d)))
query("mention_refs", f"{BASE}, {ALIASES}, {VALUES}, {GRAMS} SELECT id, subject, 'ref:' || entity_type AS predicate, to_json(entity_id)::VARCHAR AS object_json, 'mention:' || predicate AS locator FROM mentions")(
    lambda s, d: reconcile.mention_refs(_f(s, d), _e(s, d), _a(s, d)).drop("confidence"))
query("reconcile", f"""{BASE}, {ALIASES}, {WHOLE}, {GRAMS},
  found AS (SELECT subject, 'ref:' || t AS predicate, to_json(target)::VARCHAR AS object_json FROM won WHERE winners = 1 UNION SELECT subject, 'ref:' || entity_type, to_json(entity_id)::VARCHAR FROM mentions)
  SELECT * FROM found EXCEPT SELECT subject, predicate, object_json FROM facts""")(
    lambda s, d: reconcile.reconcile(_f(s, d), _e(s, d), _a(s, d)).select("subject", "predicate", "object_json"))


@query("text_candidates", f"""{BASE}, {ALIASES}, {VALUES}, {GRAMS}, hit AS (SELECT g.id AS section, a.entity_id, e.entity_type, g.gram AS surface, a.confidence, g.n, g.pos FROM grams g JOIN aliases a ON a.alias_norm = {NORM.format('g.gram')} JOIN entities e ON e.id = a.entity_id WHERE strlen(a.alias_norm) >= 2
  QUALIFY row_number() OVER (PARTITION BY g.id, e.entity_type, a.entity_id ORDER BY g.n DESC, g.pos) = 1)
  SELECT section, entity_id, entity_type, surface, confidence, row_number() OVER (PARTITION BY section ORDER BY n DESC, pos, entity_type, entity_id)::INTEGER AS place FROM hit""")
def q_candidates(s, d):
    notes = _f(s, d).where("predicate = 'note'").select(F.col("id").alias("section"), fx.string_only(F.col("object_json")).alias("text"))
    return reconcile.text_candidates(notes, _e(s, d), _a(s, d))


query("multivalue_evidence", f"""{BASE}, {DISPUTED}, dist AS (SELECT DISTINCT e.entity_type, d.predicate, d.subject, d.object_json FROM disputed d JOIN entities e ON e.id = d.subject WHERE d.predicate NOT LIKE 'ref:%' AND (d.predicate, e.entity_type) NOT IN (('brand', 'parts'))),
  per AS (SELECT entity_type, predicate, subject, list(object_json ORDER BY object_json)[1:5] AS vals FROM dist GROUP BY ALL HAVING count(*) >= 2), few AS (SELECT *, row_number() OVER (PARTITION BY entity_type, predicate ORDER BY subject) AS rn FROM per)
  SELECT entity_type, predicate, to_json(list(vals ORDER BY rn))::VARCHAR AS samples FROM few WHERE rn <= 5 GROUP BY ALL""")(
    lambda s, d: conflicts.multivalue_evidence(bridge.disputed(_f(s, d)), _e(s, d), _scalar(s).where("cardinality = 'list'")).withColumn("samples", F.to_json("samples")))
query("detect_conflicts", f"{PLAIN}, {CONFLICTS} SELECT * FROM conflicts")(lambda s, d: conflicts.detect_conflicts(bridge.disputed(_f(s, d)), _e(s, d), _scalar(s)))
DECIDED = f"""{CONFLICTS}, pri AS (SELECT * FROM (VALUES ('csv', 100), ('json', 100), ('pdf', 50), ('txt', 50), ('llm', 20)) v(adapter, p)),
  sides AS (SELECT c.*, coalesce(pa.p, 0) AS pa, coalesce(pb.p, 0) AS pb, a.confidence >= 0.7 AS oa, b.confidence >= 0.7 AS ob, a.observed_at AS ta, b.observed_at AS tb FROM conflicts c JOIN open a ON a.id = fact_a_id JOIN open b ON b.id = fact_b_id LEFT JOIN pri pa ON pa.adapter = a.adapter LEFT JOIN pri pb ON pb.adapter = b.adapter),
  decided AS (SELECT subject, predicate, fact_a_id, fact_b_id, CASE WHEN pa <> pb THEN CASE WHEN pa > pb THEN 'a' ELSE 'b' END WHEN oa <> ob THEN CASE WHEN oa THEN 'a' ELSE 'b' END WHEN ta <> tb THEN CASE WHEN ta > tb THEN 'a' ELSE 'b' END ELSE 'inbox' END AS decision FROM sides)"""


@query("resolve", f"{PLAIN}, {DECIDED} SELECT *, 'prefer:' || CASE decision WHEN 'a' THEN fact_a_id WHEN 'b' THEN fact_b_id END AS preferred FROM decided")
def q_resolve(s, d):
    f = bridge.disputed(_f(s, d))
    return conflicts.resolve(conflicts.detect_conflicts(f, _e(s, d), _scalar(s)), f)


query("resolve_stats", f"{PLAIN}, {DECIDED} SELECT decision, count(*) AS n FROM decided GROUP BY 1")(lambda s, d: q_resolve(s, d).groupBy("decision").agg(F.count("*").alias("n")))
query("graph_edges", f"{BASE}, {EDGES} SELECT * FROM edges")(lambda s, d: graph.graph_edges(_f(s, d), _e(s, d)))
query("incoming_refs", f"{BASE} SELECT {VAL} AS target, subject, predicate, coalesce(entity_type, '') AS subject_type FROM facts f LEFT JOIN entities e ON e.id = f.subject WHERE predicate LIKE 'ref:%'")(lambda s, d: graph.incoming_refs(_f(s, d), _e(s, d)).select("target", "subject", "predicate", "subject_type"))
query("neighbours", f"{BASE} SELECT DISTINCT id FROM (SELECT {VAL} AS id FROM facts WHERE predicate LIKE 'ref:%' AND subject = 'CUST-7' UNION SELECT subject FROM facts WHERE predicate LIKE 'ref:%' AND {VAL} = 'CUST-7') WHERE id <> 'CUST-7'")(lambda s, d: graph.neighbours(_f(s, d), "CUST-7"))


@query("khop_expand", f"""{BASE}, {EDGES}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
  walk AS (SELECT 'NAT-3' AS id, 0 AS distance UNION SELECT b.dst, w.distance + 1 FROM walk w JOIN ways b ON b.src = w.id WHERE w.distance < 2) SELECT id, min(distance) AS distance FROM walk GROUP BY 1""")
def q_khop(s, d):
    f, e = _f(s, d), _e(s, d)
    return graph.expand(graph.graph_edges(f, e), e, s.createDataFrame([("NAT-3",), ("NOBODY",)], "id string"), 2)


BM25 = f"""pay AS (SELECT e.id, concat_ws(' ', e.id, e.entity_type, b.body) AS text FROM entities e JOIN (SELECT subject, string_agg(concat_ws(' ', predicate, {VAL}), ' ' ORDER BY id) AS body FROM facts GROUP BY 1) b ON b.subject = e.id),
  tk AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS t FROM pay), tot AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tk),
  post AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM tk) WHERE term IN ('building', 'nat', '3') GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  hits AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN dfs USING (term), tot GROUP BY 1 ORDER BY score DESC, id LIMIT 10)"""
query("bm25_topk", f"{BASE}, {BM25} SELECT * FROM hits")(lambda s, d: search.bm25(*search.index(search.payloads(_f(s, d), _e(s, d))), "building NAT 3"))
query("retrieve", f"""{BASE}, {BM25}, {EDGES}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), one AS (SELECT id, 0 AS distance FROM hits UNION SELECT dst, 1 FROM ways WHERE src IN (SELECT id FROM hits))
  SELECT o.id, min(o.distance) AS distance, any_value(h.score) AS score FROM one o LEFT JOIN hits h USING (id) GROUP BY 1""")(lambda s, d: search.retrieve(_f(s, d), _e(s, d), "building NAT 3", 10, 1))


def _vecs(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("cosine_topk", """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def q_cosine(s, d):
    v = _vecs(s, d)
    return vectors.cosine_topk(v.where("id % 20 = 0"), v, 10)


# Sections are parts; their vectors are those of the embeddings table, by number.
HYBRID = f"""vec AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings), q AS (SELECT 'PART-' || vec_id AS section, vec_id, v FROM vec WHERE vec_id % 20 = 0),
  cand AS (SELECT 'SUPP-' || vec_id AS entity_id, vec_id, v FROM vec WHERE 'SUPP-' || vec_id IN (SELECT id FROM entities)),
  sem AS (SELECT section, entity_id, round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(c.v, c.v)), 6) AS score FROM q, cand c),
  semk AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, entity_id) AS rank FROM sem QUALIFY rank <= 5),
  txt AS (SELECT 'PART-' || p_partkey AS section, 'sold by supp-' || (p_partkey % 100) || ' and supp-' || (p_partkey % 7) || ' to cust-' || (p_partkey % 1000) AS text FROM part),
  tk AS (SELECT section, {TOKENS.format('text')} AS t FROM txt), gr AS (SELECT section, n, pos, array_to_string(t[pos:pos + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS pos FROM tk, range(1, 6) r(n) WHERE len(t) >= n)),
  al AS (SELECT g.section, a.entity_id, a.confidence, g.n, g.pos, e.entity_type FROM gr g JOIN aliases a ON a.alias_norm = g.gram JOIN entities e ON e.id = a.entity_id QUALIFY row_number() OVER (PARTITION BY g.section, a.entity_id ORDER BY g.n DESC, g.pos) = 1),
  alp AS (SELECT section, entity_id, confidence, 0 AS src, row_number() OVER (PARTITION BY section ORDER BY n DESC, pos, entity_type, entity_id) AS spot FROM al),
  both_ AS (SELECT * FROM alp UNION ALL SELECT section, entity_id, greatest(0.0, least(1.0, score)), 1, rank FROM semk),
  once AS (SELECT b.*, e.entity_type FROM both_ b JOIN entities e ON e.id = b.entity_id QUALIFY row_number() OVER (PARTITION BY section, entity_type, entity_id ORDER BY src, spot) = 1)"""


@query("hybrid_candidates", f"{BASE}, {ALIASES}, {HYBRID} SELECT section, entity_id, entity_type, round(confidence, 6) AS confidence, src, row_number() OVER (PARTITION BY section ORDER BY src, spot, entity_id)::INTEGER AS place FROM once QUALIFY place <= 6")
def q_hybrid(s, d):
    parts = s.read.schema(bridge.SCHEMAS["part"]).parquet(f"{d}/part.parquet")
    texts = parts.selectExpr("concat('PART-', p_partkey) AS section", "concat('sold by supp-', p_partkey % 100, ' and supp-', p_partkey % 7, ' to cust-', p_partkey % 1000) AS text")
    by_alias = reconcile.text_candidates(texts, _e(s, d), _a(s, d))
    v = _vecs(s, d)
    suppliers = v.select(F.concat(F.lit("SUPP-"), "id").alias("id"), "vec").join(_e(s, d).select("id"), "id", "left_semi")
    top = vectors.cosine_topk(v.where("id % 20 = 0").select(F.concat(F.lit("PART-"), "id").alias("id"), "vec"), suppliers, 5)
    by_vector = top.select(F.col("query_id").alias("section"), F.col("id").alias("entity_id"), "score", "rank")
    return vectors.hybrid_candidates(by_alias, by_vector, _e(s, d), 6).withColumn("confidence", F.round("confidence", 6))


query("card_text", f"""{BASE}, {ALIASES}, a1 AS (SELECT entity_id, alias, confidence FROM aliases WHERE lower(alias) <> lower(entity_id) QUALIFY row_number() OVER (PARTITION BY entity_id, lower(alias) ORDER BY confidence DESC, alias) = 1),
  a2 AS (SELECT entity_id, string_agg(alias, ', ' ORDER BY confidence DESC, alias) AS names FROM (SELECT * FROM a1 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY confidence DESC, alias) <= 5) GROUP BY 1),
  f1 AS (SELECT subject, id, predicate, {VAL} AS v FROM facts WHERE object_json <> 'null' QUALIFY row_number() OVER (PARTITION BY subject ORDER BY len({VAL}), id) <= 5),
  f2 AS (SELECT subject, string_agg(chr(10) || predicate || ': ' || v, '' ORDER BY len(v), id) AS body FROM f1 GROUP BY 1)
  SELECT id, entity_type, entity_type || ' ' || id || coalesce(chr(10) || 'aliases: ' || names, '') || coalesce(body, '') AS card FROM entities LEFT JOIN a2 ON entity_id = id LEFT JOIN f2 ON subject = id""")(
    lambda s, d: vectors.card_text(_f(s, d), _e(s, d), _a(s, d)).drop("card_hash"))


@query("stale_cards", f"{BASE} SELECT id FROM entities WHERE NOT id LIKE '%1'")
def q_stale(s, d):
    cards = vectors.card_text(_f(s, d), _e(s, d), _a(s, d))
    old = cards.select(F.col("id").alias("entity_id"), F.when(F.col("id").endswith("1"), F.col("card_hash")).otherwise("old").alias("card_hash"), F.lit("m").alias("model"))
    return vectors.stale_cards(cards, old, "m").select("id")


def _found(s, d):
    sections = _f(s, d).where("predicate = 'note'").select(F.col("id").cast("string").alias("section"), F.col("subject").alias("parent_subject"), fx.string_only(F.col("object_json")).alias("text"))
    target = F.concat(F.lit("CUST-"), F.regexp_extract("text", "cust-([0-9]+)", 1))
    n = F.regexp_extract("parent_subject", "([0-9]+)$", 1).cast("long")
    span = F.when(n % 3 == 0, F.concat(F.lit(" what "), F.lower(target))).when(n % 3 == 1, F.lit("never said")).otherwise(F.lit("Please send"))
    # Exploded, so that filters are worked out on an answer and not each time from its text.
    answer = F.struct(target.alias("entity_id"), span.alias("evidence_span"), F.when(n % 2 == 0, 0.95).otherwise(0.85).alias("confidence"))
    return sections.select("section", F.explode(F.array(answer)).alias("x")).select("section", "x.*"), sections


GROUND = f"""n AS (SELECT id, subject, {STR} AS text, regexp_extract(subject, '([0-9]+)$', 1)::BIGINT AS num FROM facts WHERE predicate = 'note'),
  g AS (SELECT id::VARCHAR AS section, subject, 'CUST-' || regexp_extract(text, 'cust-([0-9]+)', 1) AS entity_id, num FROM n WHERE num % 3 = 0), known AS (SELECT * FROM g WHERE entity_id IN (SELECT id FROM entities))"""


@query("ground_refs", f"{BASE}, {GROUND} SELECT section, subject, 'ref:customers' AS predicate, to_json(entity_id)::VARCHAR AS object_json, CASE WHEN num % 2 = 0 THEN 0.95::FLOAT::DOUBLE ELSE (0.85::FLOAT * 0.9::FLOAT)::FLOAT::DOUBLE END AS confidence FROM known")
def q_ground(s, d):
    found, sections = _found(s, d)
    return grounding.ground_refs(found, sections, _e(s, d), _a(s, d)).select("section", "subject", "predicate", "object_json", "confidence")


@query("learned_aliases", f"{BASE}, {GROUND} SELECT entity_id, 'what ' || lower(entity_id) AS alias, 'what ' || lower(entity_id) AS alias_norm, 'derived' AS source, CASE WHEN num % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM known")
def q_learned(s, d):
    found, sections = _found(s, d)
    return grounding.learned_aliases(grounding.ground_refs(found, sections, _e(s, d), _a(s, d)))


def _docs(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("path"), F.sha2("html", 256).alias("content_hash"))


@query("delta_status", "SELECT url AS path, CASE page_id % 3 WHEN 1 THEN sha256('new') ELSE sha256(html) END AS content_hash, CASE page_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'stale' ELSE 'cached' END AS status FROM pages")
def q_delta(s, d):
    docs = _docs(s, d)
    incoming = docs.select("path", F.when(F.col("id") % 3 == 1, F.sha2(F.lit("new"), 256)).otherwise(F.col("content_hash")).alias("content_hash"))
    return dml.delta_status(incoming, docs.where("id % 3 <> 0"))


def _store(s, d):
    f = bridge.disputed(_f(s, d)).withColumn("document_id", F.regexp_extract("subject", "([0-9]+)$", 1).cast("long") % 10)
    docs = s.range(10).select("id", F.concat(F.lit("f"), "id").alias("path"))
    return {"documents": docs, "facts": f, "conflicts": conflicts.detect_conflicts(f, _e(s, d), _scalar(s))}


@query("cascade_delete", f"{BASE}, {CONFLICTS} SELECT 'facts' AS name, count(*) AS n FROM disputed WHERE regexp_extract(subject, '([0-9]+)$', 1)::BIGINT % 10 NOT IN (3, 4) UNION ALL SELECT 'conflicts', count(*) FROM conflicts WHERE regexp_extract(subject, '([0-9]+)$', 1)::BIGINT % 10 NOT IN (3, 4) UNION ALL SELECT 'documents', 8")
def q_cascade(s, d):
    left = dml.cascade_delete(_store(s, d), s.createDataFrame([("f3",), ("f4",)], "path string"))
    return aggregates.summary(**{k: left[k] for k in ("facts", "conflicts", "documents")})


@query("clear_llm", f"{BASE}, {CONFLICTS} SELECT 'facts' AS name, count(*) AS n FROM disputed WHERE adapter <> 'llm' UNION ALL SELECT 'conflicts', count(*) FROM conflicts WHERE fact_a_id NOT IN (SELECT id FROM disputed WHERE adapter = 'llm') AND fact_b_id NOT IN (SELECT id FROM disputed WHERE adapter = 'llm')")
def q_clear(s, d):
    t = _store(s, d) | {"section_cache": s.createDataFrame([], "section_hash string"), "entity_aliases": _a(s, d)}
    left = dml.clear_llm(t)
    return aggregates.summary(facts=left["facts"], conflicts=left["conflicts"])


@query("suppress_fact", f"{BASE} SELECT id, CASE WHEN subject = 'ORD-5' THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM facts WHERE predicate = 'ref:customers'")
def q_suppress(s, d):
    f = _f(s, d).where("predicate = 'ref:customers'").withColumn("adapter", F.lit("llm-resolve"))
    target = fx.unquote(F.col("object_json"))
    row = f.where("subject = 'ORD-5'").select(target.alias("t")).first()
    return dml.suppress_fact(f, "ORD-5", "ref:customers", row["t"] if row else "").select("id", "confidence")


@query("keep_latest", "SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_latest(s, d):
    old = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    return dml.keep_latest(old, s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v")), ["k"], "v")


@query("insert_new", "SELECT c_custkey AS id, 'customers' AS entity_type FROM customer UNION ALL SELECT o_orderkey, 'orders' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def q_insert(s, d):
    old = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.lit("customers").alias("entity_type"))
    new = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("entity_type"))
    return dml.insert_new(old, new, ["id"])


@query("section_cache_miss", "SELECT doc_id AS section FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def q_misses(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("section"), "text")
    cache = docs.where("section % 2 = 0").select(F.sha2("text", 256).alias("section_hash"))
    return grounding.uncached(docs, cache).select("section")


query("reconcile_stats", f"""{BASE}, {ALIASES}, {WHOLE}, {GRAMS}, found AS (SELECT subject, 'ref:' || t AS predicate, to_json(target)::VARCHAR AS object_json FROM won WHERE winners = 1 UNION SELECT subject, 'ref:' || entity_type, to_json(entity_id)::VARCHAR FROM mentions)
  SELECT 'scanned' AS name, count(*) AS n FROM strs UNION ALL SELECT 'ambiguous', count(*) FROM won WHERE winners <> 1 UNION ALL SELECT 'mentions', count(*) FROM mentions
  UNION ALL SELECT 'emitted', count(*) FROM (SELECT * FROM found EXCEPT SELECT subject, predicate, object_json FROM facts)""")(lambda s, d: reconcile.reconcile_stats(_f(s, d), _e(s, d), _a(s, d)))


@query("count_predicate", f"{BASE} SELECT 'ref' AS kind, count(*) AS n FROM facts WHERE predicate = 'ref:nations' AND object_json = '\"NAT-3\"' UNION ALL SELECT 'attribute', count(*) FROM facts WHERE predicate = 'status' AND object_json = '\"F\"'")
def q_count_predicate(s, d):
    one = aggregates.count_predicate(_f(s, d), "ref:nations", "NAT-3").select(F.lit("ref").alias("kind"), "n")
    return one.union(aggregates.count_predicate(_f(s, d), "status", "F").select(F.lit("attribute").alias("kind"), "n"))


def _recorded(s, d):
    """Conflicts with numbers in order of their first fact; every third resolved."""
    c = conflicts.detect_conflicts(bridge.disputed(_f(s, d)), _e(s, d), _scalar(s))
    return c.select(F.col("fact_b_id").alias("id"), "subject", "predicate", "fact_a_id", "fact_b_id", F.when(F.col("fact_b_id") % 3 == 0, 5).cast("long").alias("resolved_at"), F.lit(None).cast("string").alias("resolution"))


query("unresolved_conflicts", f"{PLAIN}, {CONFLICTS} SELECT fact_b_id AS id, subject FROM conflicts WHERE fact_b_id % 3 <> 0")(lambda s, d: conflicts.unresolved(_recorded(s, d)).select("id", "subject"))
query("resolve_conflict", f"{PLAIN}, {CONFLICTS} SELECT fact_b_id AS id, CASE WHEN fact_b_id = (SELECT min(fact_b_id) FROM conflicts) THEN 9 WHEN fact_b_id % 3 = 0 THEN 5 ELSE -1 END::BIGINT AS resolved_at, CASE WHEN fact_b_id = (SELECT min(fact_b_id) FROM conflicts) THEN 'prefer:x' ELSE '' END AS resolution FROM conflicts")(
    lambda s, d: dml.resolve_conflict(_recorded(s, d), _recorded(s, d).agg(F.min("id")).first()[0] or 0, "prefer:x", 9).select("id", F.coalesce("resolved_at", F.lit(-1)).cast("long").alias("resolved_at"), F.coalesce("resolution", F.lit("")).alias("resolution")))
query("clear_cardinality", f"{PLAIN}, {CONFLICTS} SELECT 'conflicts' AS name, count(*) FILTER (WHERE fact_b_id % 3 = 0) AS n FROM conflicts UNION ALL SELECT 'predicate_cardinality', 0")(
    lambda s, d: aggregates.summary(**dml.clear_cardinality({"predicate_cardinality": _scalar(s), "conflicts": _recorded(s, d)})))
query("recommended_side", f"""{PLAIN}, {CONFLICTS}, s AS (SELECT c.fact_a_id, c.fact_b_id, a.confidence AS ca, b.confidence AS cb, a.observed_at AS ta, b.observed_at AS tb FROM conflicts c JOIN open a ON a.id = fact_a_id JOIN open b ON b.id = fact_b_id)
  SELECT fact_a_id, fact_b_id, CASE WHEN ca > cb THEN 'a' WHEN ca < cb THEN 'b' WHEN ta > tb THEN 'a' WHEN ta < tb THEN 'b' END AS side FROM s""")(
    lambda s, d: conflicts.conflict_sides(_recorded(s, d), bridge.disputed(_f(s, d))).select("fact_a_id", "fact_b_id", conflicts.recommended_side().alias("side")))


def _links(s, d):
    f = _f(s, d).where("predicate = 'ref:customers'")
    return f.withColumns({"adapter": F.lit("llm-resolve"), "confidence": F.round(F.col("id") % 11 / 10, 1), "observed_at": F.col("id") % 1000})


LINKS = "links AS (SELECT id, round(id % 11 / 10, 1)::FLOAT::DOUBLE AS confidence, id % 1000 AS observed_at FROM facts WHERE predicate = 'ref:customers')"
query("recent_resolutions", f"{BASE}, {LINKS}, newest AS (SELECT * FROM links ORDER BY observed_at DESC, id DESC LIMIT 100) SELECT id, observed_at FROM newest WHERE confidence > 0 AND confidence < 0.9")(lambda s, d: conflicts.recent_resolutions(_links(s, d)).select("id", "observed_at"))
query("recent_resolutions_since", f"{BASE}, {LINKS}, newest AS (SELECT * FROM links WHERE observed_at >= 990 ORDER BY observed_at DESC, id DESC LIMIT 1000) SELECT id, observed_at FROM newest WHERE confidence > 0 AND confidence < 0.5")(lambda s, d: conflicts.recent_resolutions(_links(s, d), 990, 1000, 0.5).select("id", "observed_at"))
query("clear_reconciled", f"{BASE} SELECT count(*) AS n FROM facts WHERE id % 5 <> 0")(
    lambda s, d: dml.clear_reconciled({"facts": _f(s, d).withColumn("adapter", F.when(F.col("id") % 5 == 0, "alias-reconcile").otherwise("json")), "conflicts": s.createDataFrame([], "fact_a_id long, fact_b_id long")})["facts"].agg(F.count("*").alias("n")))


@query("append_facts", "SELECT o_orderkey, (SELECT count(*) FROM customer) + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders UNION ALL SELECT -1, row_number() OVER (ORDER BY c_custkey) FROM customer")
def q_append(s, d):
    old = dml.number_on(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), F.lit(None).cast("long").alias("o_orderkey")), ["c_custkey"], 0)
    new = s.read.parquet(f"{d}/orders.parquet").select(F.lit(None).cast("long").alias("c_custkey"), "o_orderdate", "o_orderkey")
    return dml.append_facts(old, new, ["o_orderdate", "o_orderkey"]).select(F.coalesce("o_orderkey", F.lit(-1)).cast("long").alias("o_orderkey"), "id")


query("list_entities", f"{BASE} SELECT id FROM entities WHERE entity_type = 'suppliers' AND contains(lower(id), 'p-1')")(lambda s, d: dml.entities_holding(_e(s, d), "suppliers", "P-1"))
query("entity_vectors", f"{BASE} SELECT 'SUPP-' || vec_id AS id, 'suppliers' AS entity_type FROM embeddings WHERE vec_id % 2 = 0 AND 'SUPP-' || vec_id IN (SELECT id FROM entities)")(
    lambda s, d: vectors.entity_vectors(_vecs(s, d).select(F.concat(F.lit("SUPP-"), "id").alias("entity_id"), F.col("vec").alias("embedding"), F.when(F.col("id") % 2 == 0, "m").otherwise("n").alias("model")), _e(s, d), "m").select("id", "entity_type"))
query("safe_names", "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_.@+=~-]', '_', 'g') AS safe, sha256(html) AS h, CASE WHEN length(html) > 500 THEN left(html, 250) || '…[' || (length(html) - 500) || ' chars elided]…' || right(html, 250) ELSE html END AS short, CASE WHEN length(html) > 80 THEN left(html, 80) || '…' ELSE html END AS cut FROM pages")(
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", fx.sanitize_id(F.col("url")).alias("safe"), fx.sha256(F.col("html")).alias("h"), fx.shorten(F.col("html")).alias("short"), fx.truncate(F.col("html"), 80).alias("cut")))
query("strip_fences", "SELECT doc_id, trim(text) AS plain FROM documents WHERE text NOT LIKE '%```%'")(
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").where("text NOT LIKE '%```%'").select("doc_id", fx.strip_fences(F.concat(F.lit("```json\n"), F.trim("text"), F.lit("\n```"))).alias("plain")))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

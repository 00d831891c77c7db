"""Registered queries over the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import keyword_set, overlap, preview, wrap
from ..operators import layout
from ..operators.graph import KnowledgeGraph
from ..operators.link import relationship_counts, relationships
from ..operators.validate import batched, threshold_filter, validation_rate
from ..schemas import COLUMN_X, ENTITY_TYPES, LEVELS, RULES, STOP_WORDS, TYPE_SETTINGS, WIDE_TYPES
from . import fixtures as fx

WORD_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 3 AND NOT list_contains([" + WORD_LIST + "], w)))"


def _rules_sql() -> str:
    rows = []
    for r in RULES:
        sections = "NULL::VARCHAR[]" if r.dst_sections is None else "[" + ", ".join(f"'{s}'" for s in r.dst_sections) + "]"
        rows.append(f"({r.rule_id}, '{r.rel_type}', '{r.src_type}', '{r.dst_type}', '{r.rule}', {r.f_hi}::DOUBLE, {r.f_lo}::DOUBLE, {sections}, {r.same_section}, '{r.hi_kind}', {r.hi_threshold}::DOUBLE)")
    return "rules(rule_id, rel_type, src_type, dst_type, rule, f_hi, f_lo, dst_sections, same_section, hi_kind, hi_threshold) AS (VALUES " + ", ".join(rows) + ")"


EDGES_SQL = f"""{fx.ENTITY_SQL}, {_rules_sql()}, tok AS (SELECT *, {TOKENS.format('text')} AS tokens FROM fx), pairs AS (
  SELECT a.paper_id, r.rule_id, a.id AS source_id, b.id AS target_id, r.rel_type, r.rule, r.hi_kind, r.hi_threshold, r.f_hi, r.f_lo, least(a.confidence, b.confidence) AS m,
    a.source_section IS NOT DISTINCT FROM b.source_section AS same, a.source_section AS section,
    CASE WHEN r.hi_kind <> 'overlap' THEN NULL WHEN len(a.tokens) = 0 OR len(b.tokens) = 0 THEN 0::DOUBLE
      ELSE len(list_intersect(a.tokens, b.tokens))::DOUBLE / (len(a.tokens) + len(b.tokens) - len(list_intersect(a.tokens, b.tokens))) END AS text_overlap
  FROM tok a JOIN rules r ON a.type = r.src_type JOIN tok b ON b.paper_id = a.paper_id AND b.type = r.dst_type
    AND (r.dst_sections IS NULL OR list_contains(r.dst_sections, b.source_section)) AND (NOT r.same_section OR a.source_section IS NOT DISTINCT FROM b.source_section)
), e AS (
  SELECT paper_id, rule_id, source_id, target_id, rel_type AS relationship_type, rule, text_overlap,
    m * CASE WHEN hi_kind = 'always' OR (hi_kind = 'overlap' AND text_overlap > hi_threshold) OR (hi_kind = 'section' AND same) THEN f_hi ELSE f_lo END AS confidence,
    CASE WHEN rule_id = 1 THEN section END AS section, CASE WHEN hi_kind = 'section' THEN same END AS same_section
  FROM pairs
), edges AS (SELECT * FROM e WHERE confidence >= 0.6::DOUBLE)"""
EDGE_COLUMNS = "paper_id, rule_id, source_id, target_id, relationship_type, confidence, rule, section, text_overlap, same_section"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def graph(spark, sf_dir) -> KnowledgeGraph:
    vertices = fx.entities(spark, sf_dir)
    return KnowledgeGraph(vertices, relationships(vertices))


def a_middle(spark, sf_dir) -> str:
    """One id to look up: the smallest that an edge leaves and another reaches."""
    e = graph(spark, sf_dir).edges
    return e.select(F.col("source_id").alias("id")).intersect(e.select("target_id")).agg(F.min("id")).first()[0]


ONE = "one AS (SELECT min(source_id) AS id FROM edges WHERE source_id IN (SELECT target_id FROM edges))"


@query("token_sets", f"WITH {fx.ENTITY_SQL} SELECT doc_id, len({TOKENS.format('text')}) AS n_tokens FROM fx")
def token_sets(spark, sf_dir):
    return fx.entities(spark, sf_dir).select("doc_id", F.size(keyword_set(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    "jaccard_pairs",
    f"""WITH {fx.ENTITY_SQL}, t AS (SELECT paper_id, id, type, {TOKENS.format('text')} AS k FROM fx WHERE type IN ('fact', 'dataset'))
    SELECT a.paper_id, a.id AS a_id, b.id AS b_id, CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0::DOUBLE ELSE len(list_intersect(a.k, b.k))::DOUBLE / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END AS overlap
    FROM t a JOIN t b ON a.paper_id = b.paper_id AND a.type = 'fact' AND b.type = 'dataset'""",
)
def jaccard_pairs(spark, sf_dir):
    t = fx.entities(spark, sf_dir).select("paper_id", "id", "type", keyword_set(F.col("text")).alias("k"))
    a = t.where("type = 'fact'").select("paper_id", F.col("id").alias("a_id"), F.col("k").alias("ak"))
    b = t.where("type = 'dataset'").select("paper_id", F.col("id").alias("b_id"), F.col("k").alias("bk"))
    return a.join(b, "paper_id").select("paper_id", "a_id", "b_id", overlap(F.col("ak"), F.col("bk")).alias("overlap"))


def _link(rule):
    def run(spark, sf_dir):
        from ..schemas import rule_table

        return relationships(fx.entities(spark, sf_dir), rules=rule_table(spark).where(F.col("rule_id") == rule.rule_id)).select(*EDGE_COLUMNS.split(", "))

    return run


for _rule in RULES:
    _names = {3: "link_experiment_method", 4: "link_experiment_dataset"}
    _name = _names.get(_rule.rule_id, "link_" + _rule.rel_type.replace("_to_", "_"))
    query(_name, f"WITH {EDGES_SQL} SELECT {EDGE_COLUMNS} FROM edges WHERE rule_id = {_rule.rule_id}")(_link(_rule))


@query("assemble_graph", f"WITH {EDGES_SQL} SELECT {EDGE_COLUMNS} FROM edges")
def assemble_graph(spark, sf_dir):
    return relationships(fx.entities(spark, sf_dir)).select(*EDGE_COLUMNS.split(", "))


@query("relationship_counts", f"WITH {EDGES_SQL} SELECT relationship_type, count(*) AS n FROM edges GROUP BY ALL")
def edge_counts(spark, sf_dir):
    return relationship_counts(relationships(fx.entities(spark, sf_dir)))


@query("group_by_type", f"WITH {fx.ENTITY_SQL} SELECT type, list_position([{', '.join(repr(t) for t in ENTITY_TYPES)}], type) - 1 AS type_ord, count(*) AS n FROM fx GROUP BY ALL")
def group_by_type(spark, sf_dir):
    return KnowledgeGraph(fx.entities(spark, sf_dir), None).type_summary()


@query(
    "graph_statistics",
    f"""WITH {EDGES_SQL}
    SELECT paper_id, CASE WHEN grouping(type) = 1 THEN 'total_entities' ELSE 'entities_by_type' END AS level, type AS name, count(*) AS n FROM fx GROUP BY GROUPING SETS ((paper_id), (paper_id, type))
    UNION ALL SELECT paper_id, CASE WHEN grouping(relationship_type) = 1 THEN 'total_relationships' ELSE 'relationships_by_type' END, relationship_type, count(*) FROM edges
      GROUP BY GROUPING SETS ((paper_id), (paper_id, relationship_type))""",
)
def graph_statistics(spark, sf_dir):
    return graph(spark, sf_dir).statistics()


@query("graph_totals", f"WITH {EDGES_SQL} SELECT (SELECT count(*) FROM fx) AS total_entities, (SELECT count(*) FROM edges) AS total_relationships")
def graph_totals(spark, sf_dir):
    return graph(spark, sf_dir).totals()


@query(
    "avg_degree",
    f"WITH {EDGES_SQL}, v AS (SELECT paper_id, count(*) AS v FROM fx GROUP BY 1), d AS (SELECT paper_id, count(*) AS e FROM edges GROUP BY 1) SELECT v.paper_id, coalesce(d.e::DOUBLE / v.v, 0) AS avg_degree FROM v LEFT JOIN d USING (paper_id)",
)
def avg_degree(spark, sf_dir):
    return graph(spark, sf_dir).average_degree()


@query("entity_lookup", f"WITH {EDGES_SQL}, {ONE} SELECT fx.* FROM fx JOIN one USING (id)")
def entity_lookup(spark, sf_dir):
    return KnowledgeGraph(fx.entities(spark, sf_dir), None).entity(a_middle(spark, sf_dir))


@query("entities_by_type", f"WITH {fx.ENTITY_SQL} SELECT * FROM fx WHERE type = 'method'")
def entities_by_type(spark, sf_dir):
    return KnowledgeGraph(fx.entities(spark, sf_dir), None).entities_by_type("method")


def _incident(direction):
    return lambda spark, sf_dir: graph(spark, sf_dir).incident(a_middle(spark, sf_dir), direction).select(*EDGE_COLUMNS.split(", "))


for _d, _where in {"in": "target_id = one.id", "out": "source_id = one.id", "both": "target_id = one.id OR source_id = one.id"}.items():
    query(f"incident_{_d}", f"WITH {EDGES_SQL}, {ONE} SELECT {EDGE_COLUMNS} FROM edges, one WHERE {_where}")(_incident(_d))


@query("neighbors", f"WITH {EDGES_SQL}, {ONE} SELECT target_id AS id FROM edges, one WHERE source_id = one.id UNION SELECT source_id FROM edges, one WHERE target_id = one.id")
def neighbors(spark, sf_dir):
    return graph(spark, sf_dir).neighbors(a_middle(spark, sf_dir))


@query("all_neighbors", f"WITH {EDGES_SQL} SELECT source_id AS id, target_id AS neighbor FROM edges UNION SELECT target_id, source_id FROM edges")
def all_neighbors(spark, sf_dir):
    return graph(spark, sf_dir).all_neighbors()


CUT = "CASE WHEN length({0}) > {1} THEN substr({0}, 1, {1}) || '...' ELSE {0} END"


@query(
    "edge_endpoints",
    f"""WITH {EDGES_SQL}, picked AS (SELECT * FROM edges ORDER BY paper_id, rule_id, source_id, target_id LIMIT 5)
    SELECT s.paper_id, s.source_id, s.target_id, s.relationship_type, {CUT.format('a.text', 40)} AS source_text, {CUT.format('b.text', 40)} AS target_text
    FROM picked s JOIN fx a ON a.id = s.source_id AND a.paper_id = s.paper_id JOIN fx b ON b.id = s.target_id AND b.paper_id = s.paper_id""",
)
def edge_endpoints(spark, sf_dir):
    return graph(spark, sf_dir).edge_endpoints()


@query(
    "top3_per_type",
    f"""WITH {fx.ENTITY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, type ORDER BY confidence DESC, id) AS rank FROM fx)
    SELECT paper_id, type, rank, id, confidence, {CUT.format('text', 60)} AS preview FROM r WHERE rank <= 3""",
)
def top3_per_type(spark, sf_dir):
    return graph(spark, sf_dir).top_per_type()


@query(
    "simple_edges",
    f"WITH {EDGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, source_id, target_id ORDER BY rule_id DESC) AS k FROM edges) SELECT paper_id, source_id, target_id, relationship_type, confidence FROM r WHERE k = 1",
)
def simple_edges(spark, sf_dir):
    return graph(spark, sf_dir).simple_edges()


@query("text_preview", f"WITH {fx.ENTITY_SQL} SELECT doc_id, {CUT.format('text', 50)} AS preview FROM fx")
def text_preview(spark, sf_dir):
    return fx.entities(spark, sf_dir).select("doc_id", preview(F.col("text"), 50).alias("preview"))


@query(
    "cytoscape_elements",
    f"""WITH {EDGES_SQL}
    SELECT paper_id, to_json({{'data': {{'id': id, 'label': substr(text, 1, 50), 'type': type, 'confidence': confidence}}}})::VARCHAR AS json FROM fx
    UNION ALL SELECT paper_id, to_json({{'data': {{'source': source_id, 'target': target_id, 'label': relationship_type, 'confidence': confidence}}}})::VARCHAR FROM edges""",
)
def cytoscape_elements(spark, sf_dir):
    return graph(spark, sf_dir).cytoscape()


@query(
    "result_export",
    f"""WITH {EDGES_SQL}
    SELECT 'entity' AS kind, paper_id, id AS a, source_section AS b, type, confidence, sha256(text) AS text FROM fx
    UNION ALL SELECT 'relationship', paper_id, source_id, target_id, relationship_type, confidence, NULL FROM edges""",
)
def result_export(spark, sf_dir):
    """The exported JSON, read back."""
    from ..sources.results import parse_results, result_json

    back = parse_results(result_json(graph(spark, sf_dir).results()))
    v = back.vertices.select(F.lit("entity").alias("kind"), "paper_id", F.col("id").alias("a"), F.col("source_section").alias("b"), "type", "confidence", F.sha2("text", 256).alias("text"))
    e = back.edges.select(F.lit("relationship").alias("kind"), "paper_id", F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("relationship_type").alias("type"), "confidence", F.lit(None).cast("string").alias("text"))
    return v.unionByName(e)


def _case(values: dict, other) -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


@query(
    "level_layout",
    f"WITH {fx.ENTITY_SQL}, l AS (SELECT *, {_case(LEVELS, 3)} AS level FROM fx) SELECT paper_id, id, row_number() OVER (PARTITION BY paper_id, level ORDER BY id) - 1 AS x, -level AS y FROM l",
)
def level_layout(spark, sf_dir):
    return layout.level_layout(fx.entities(spark, sf_dir))


# The lines of a text by a fold in SQL too: the state is the finished lines, the open one, its words' characters and its words.
WRAPPED = """list_reduce(list_prepend({{'d': '', 'l': '', 'n': 1, 'c': 0, 'w': 0}}, list_transform(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> ''), lambda x: {{'d': '', 'l': x, 'n': 0, 'c': length(x), 'w': 1}})),
  lambda a, b: CASE WHEN a.w > 0 AND a.c + b.c + a.w > 25 THEN {{'d': a.d || a.l || chr(10), 'l': b.l, 'n': a.n + 1, 'c': b.c, 'w': 1}}
    ELSE {{'d': a.d, 'l': CASE WHEN a.w = 0 THEN b.l ELSE a.l || ' ' || b.l END, 'n': a.n, 'c': a.c + b.c, 'w': a.w + 1}} END)"""
PLACED_SQL = f"""{EDGES_SQL}, wr AS (SELECT *, {WRAPPED.format("coalesce(text, '')")} AS s FROM fx),
h AS (SELECT paper_id, id, type, s, {_case(COLUMN_X, 850)} AS x, greatest(80, (CASE WHEN s.w = 0 THEN 0 ELSE s.n END) * 16 + 40) AS height FROM wr),
placed AS (SELECT *, 100 + coalesce(sum(height + 20) OVER (PARTITION BY paper_id, x ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM h)"""


@query("column_layout", f"WITH {PLACED_SQL} SELECT paper_id, id, type, x, CAST(y AS BIGINT) AS y, height FROM placed")
def column_layout(spark, sf_dir):
    return layout.column_layout(fx.entities(spark, sf_dir)).drop("lines")


WIDE = ", ".join(f"'{t}'" for t in WIDE_TYPES)


@query(
    "edge_geometry",
    f"""WITH {PLACED_SQL}, p AS (SELECT *, CASE WHEN type IN ({WIDE}) THEN 224 ELSE 200 END AS width FROM placed),
    g AS (SELECT e.paper_id, source_id, target_id, relationship_type, a.x + a.width AS x1, a.y + a.height / 2::DOUBLE AS y1, b.x AS x2, b.y + b.height / 2::DOUBLE AS y2
      FROM edges e JOIN p a ON a.paper_id = e.paper_id AND a.id = e.source_id JOIN p b ON b.paper_id = e.paper_id AND b.id = e.target_id)
    SELECT *, x1 + (x2 - x1) / 2::DOUBLE AS cx1, x2 - (x2 - x1) / 2::DOUBLE AS cx2 FROM g""",
)
def edge_geometry(spark, sf_dir):
    g = graph(spark, sf_dir)
    return layout.edge_geometry(layout.column_layout(g.vertices), g.edges).drop("colour")


COLOUR = "CASE relationship_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in layout.COLOURS.items()) + " END"
ESCAPED = """replace(replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')"""


@query(
    "svg_documents",
    f"""WITH {PLACED_SQL}, p AS (SELECT *, CASE WHEN type IN ({WIDE}) THEN 224 ELSE 200 END AS width FROM placed),
    g AS (SELECT e.paper_id, source_id, target_id, relationship_type, a.x + a.width AS x1, a.y + a.height / 2::DOUBLE AS y1, b.x AS x2, b.y + b.height / 2::DOUBLE AS y2
      FROM edges e JOIN p a ON a.paper_id = e.paper_id AND a.id = e.source_id JOIN p b ON b.paper_id = e.paper_id AND b.id = e.target_id),
    ln AS (SELECT paper_id, id, x, y, unnest(string_split(s.d || s.l, chr(10))) AS line, generate_subscripts(string_split(s.d || s.l, chr(10)), 1) - 1 AS k FROM p WHERE s.w > 0),
    tx AS (SELECT paper_id, id, string_agg('<text x="' || (x + 10) || '" y="' || CAST(y + 24 + k * 16 AS BIGINT) || '">' || {ESCAPED} || '</text>', '' ORDER BY k) AS body FROM ln GROUP BY 1, 2),
    pieces AS (
      SELECT paper_id, 0 AS layer, source_id || '|' || target_id || '|' || relationship_type AS ord, printf('<path d="M%.1f %.1f C%.1f %.1f %.1f %.1f %.1f %.1f" fill="none" stroke="%s"/>',
        x1::DOUBLE, y1, x1 + (x2 - x1) / 2::DOUBLE, y1, x2 - (x2 - x1) / 2::DOUBLE, y2, x2::DOUBLE, y2, {COLOUR}) AS piece FROM g
      UNION ALL SELECT paper_id, 1, id, '<rect x="' || x || '" y="' || CAST(y AS BIGINT) || '" width="' || width || '" height="' || height || '"/>' || coalesce(body, '') FROM p LEFT JOIN tx USING (paper_id, id)),
    v AS (SELECT paper_id, CAST(max(y + height + 20) + 150 AS BIGINT) AS canvas FROM placed GROUP BY 1),
    b AS (SELECT paper_id, count(*) AS n_pieces, string_agg(piece, chr(10) ORDER BY layer, ord, piece) AS body FROM pieces GROUP BY 1)
    SELECT paper_id, n_pieces, sha256('<svg xmlns="http://www.w3.org/2000/svg" width="2400" height="' || canvas || '">' || chr(10) || body || chr(10) || '</svg>') AS svg FROM b JOIN v USING (paper_id)""",
)
def svg_documents(spark, sf_dir):
    """The drawings, by their digests."""
    g = graph(spark, sf_dir)
    svg = layout.svg_documents(g.vertices, g.edges)
    return svg.select("paper_id", (F.size(F.split("svg", r"<(?=rect |path )", -1)) - 1).cast("long").alias("n_pieces"), F.sha2("svg", 256).alias("svg"))


@query("wrap_text", f"WITH {PLACED_SQL} SELECT doc_id, (CASE WHEN s.w = 0 THEN 0 ELSE s.n END)::BIGINT AS n_lines, sha256(s.d || s.l) AS lines FROM wr")
def wrap_text(spark, sf_dir):
    lines = fx.entities(spark, sf_dir).select("doc_id", wrap(F.coalesce("text", F.lit(""))).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines"))


@query(
    "batching",
    f"""WITH {fx.ENTITY_SQL}, r AS (SELECT paper_id, type AS entity_type, id, row_number() OVER (PARTITION BY paper_id, type ORDER BY confidence DESC, id) AS rank FROM fx)
    SELECT *, CAST((rank - 1) // 5 AS INT) AS batch_id, CAST((rank - 1) % 5 + 1 AS INT) AS fragment_id FROM r""",
)
def batching(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("paper_id", "type").orderBy(F.desc("confidence"), "id")
    ranked = fx.entities(spark, sf_dir).select("paper_id", F.col("type").alias("entity_type"), "id", F.row_number().over(order).alias("rank"))
    return batched(ranked)


@query(
    "prompt_lines",
    f"""WITH {fx.ENTITY_SQL}, r AS (SELECT paper_id, type AS entity_type, text, row_number() OVER (PARTITION BY paper_id, type ORDER BY confidence DESC, id) AS rank FROM fx),
    b AS (SELECT *, CAST((rank - 1) // 5 AS INT) AS batch_id, (rank - 1) % 5 + 1 AS fragment_id FROM r)
    SELECT paper_id, entity_type, batch_id, count(*) AS n, string_agg('[' || fragment_id || '] ' || substr(coalesce(text, ''), 1, 300), chr(10) ORDER BY fragment_id) AS lines FROM b GROUP BY ALL""",
)
def prompt_lines(spark, sf_dir):
    from pyspark.sql import Window

    from ..operators.validate import batch_prompts

    order = Window.partitionBy("paper_id", "type").orderBy(F.desc("confidence"), "id")
    ranked = fx.entities(spark, sf_dir).select("paper_id", F.col("type").alias("entity_type"), "id", "text", F.row_number().over(order).alias("rank"))
    made = batch_prompts(batched(ranked))
    return made.select("paper_id", "entity_type", "batch_id", F.col("n").cast("long").alias("n"), F.regexp_replace("prompt", r"(?s)^.*?core_text\.\n", "").alias("lines"))


SCORED = fx.ENTITY_SQL.replace("fx AS", "f0 AS", 1) + ", fx AS (SELECT * REPLACE (0.5::DOUBLE + ((doc_id * 13) % 47)::DOUBLE / 100::DOUBLE AS confidence) FROM f0)"
THRESHOLD = "CASE type " + " ".join(f"WHEN '{t}' THEN {s.threshold}::DOUBLE" for t, s in TYPE_SETTINGS.items()) + " ELSE 0.7::DOUBLE END"


@query("threshold_filter", f"WITH {SCORED} SELECT doc_id, type, confidence FROM fx WHERE confidence >= {THRESHOLD}")
def thresholds(spark, sf_dir):
    return threshold_filter(fx.scored(spark, sf_dir)).select("doc_id", "type", "confidence")


@query(
    "validation_rate",
    f"""WITH {SCORED}, c AS (SELECT type, count(*) AS candidates, count(*) FILTER (WHERE confidence >= {THRESHOLD}) AS validated FROM fx GROUP BY 1)
    SELECT *, candidates - validated AS rejected, validated::DOUBLE / candidates AS rate FROM c""",
)
def rates(spark, sf_dir):
    return validation_rate(fx.scored(spark, sf_dir))

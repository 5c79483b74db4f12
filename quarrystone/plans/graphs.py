"""Queries by operators beyond one SQL statement, on the engine's networks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.dialect import Check, Spark
from quarrystone.functions import names, recognition
from quarrystone.functions.fuzzy import extended_hamming, osa, token_positions
from quarrystone.functions.openers import opener
from quarrystone.functions.phonetic import codes
from quarrystone.operators import centrality, citations, communities, cycles, labels, thresholds, topology
from quarrystone.operators.components import connected_components
from quarrystone.operators.cosine import link_counts
from quarrystone.operators.scratch import passing, shared_folder
from quarrystone.operators.together import shared_counts
from quarrystone.operators.upsert import upsert
from quarrystone.plans.derived import derived_sql
from quarrystone.plans.exports import CHUNK, export
from quarrystone.plans.statements import PERIODS


_sql = derived_sql


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs (u, v, w), of the stored table: every operator below reads them more than once."""
    return _sql(spark, sf_dir, "SELECT * FROM links")


def s9_upsert(spark, sf_dir):
    old = _sql(spark, sf_dir, "SELECT v1, v2, similarity, dist FROM queue WHERE dist <= 3")
    new = _sql(spark, sf_dir, "SELECT v1, v2, similarity * 0.9 AS similarity, dist + 1 AS dist FROM queue WHERE dist >= 2")
    return upsert(old, new, ["v1", "v2"], {"similarity": "greatest", "dist": "least"}).withColumn("similarity", F.round("similarity", 6))


def x2_osa_distance(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT v1, v2 FROM queue").withColumn("dist", osa("v1", "v2"))


def x3_hamming_columns(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT v1, v2 FROM queue").withColumn("dist", extended_hamming(F.col("v1"), F.col("v2")).cast("long"))


def x29_token_positions(spark, sf_dir):
    rows = _sql(spark, sf_dir, "SELECT doc_id, text FROM docs").select("doc_id", F.explode(token_positions("text")).alias("t"))
    return rows.select("doc_id", "t.word", "t.start", "t.end", "t.before", "t.after")


def j4_unordered_pairs(spark, sf_dir):
    return shared_counts(_sql(spark, sf_dir, "SELECT file_path, name_string FROM mentions"), "file_path", "name_string", 2)


def g8_h0_persistence(spark, sf_dir):
    links = _links(spark, sf_dir)
    return topology.h0_persistence(links, spark.read.parquet(f"{sf_dir}/documents.parquet").count())


def g10_betti_curve(spark, sf_dir):
    links = _links(spark, sf_dir)
    vertices = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return topology.betti_curve(links, vertices, [round(0.1 + 0.05 * i, 2) for i in range(18)])


def g15_connected_components(spark, sf_dir):
    return connected_components(_links(spark, sf_dir), shared_folder(spark))


def g16_component_degree(spark, sf_dir):
    """Degrees by links of 0.5 and more, as shares of the others in the component; no other links are made."""
    members = _sql(spark, sf_dir, "SELECT node, community AS component FROM members")
    close = _sql(spark, sf_dir, "SELECT doc_id_1 AS u, doc_id_2 AS v, cosine_similarity AS w FROM close_pairs")
    degree = centrality.sides(close).groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    found = members.join(members.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "component").join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return found.select("node", "component", "degree", F.round(F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0), 6).alias("centrality"))


def g21_community_edges(spark, sf_dir):
    """Links within and out of each community, counted where similar pairs are found."""
    members = _sql(spark, sf_dir, "SELECT node, community FROM members")
    labels = members.groupBy(F.col("node").alias("id")).agg(F.min("community").alias("label"), F.count(F.lit(1)).alias("times"))
    rows = _sql(spark, sf_dir, "SELECT doc_id AS id, term, w FROM tfidf")
    count = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    found = link_counts(rows, count, 0.1, labels).withColumnRenamed("label", "community")
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("nodes")).join(found, "community", "left")
    each = sizes.select("community", "nodes", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("internal", "external")))
    return each.withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("internal") / (F.col("nodes") * (F.col("nodes") - 1) / 2)).otherwise(0.0), 6))


def g17_path_metrics(spark, sf_dir):
    """Betweenness by similarities as lengths, and closeness by steps, each within its component."""
    return centrality.weighted_path_metrics(_links(spark, sf_dir))


def g23_bridges(spark, sf_dir):
    """The twenty documents of greatest betweenness, above 0, among links of 0.5 and more, with the communities around them."""
    strong = _links(spark, sf_dir).where("w >= 0.5")
    members = _sql(spark, sf_dir, "SELECT node, community FROM members")
    top = centrality.weighted_path_metrics(strong).where("betweenness > 0").orderBy(F.desc("betweenness"), "node").limit(20).select("node", "betweenness")
    return centrality.bridges(strong, members, top)


def g33_path_statistics(spark, sf_dir):
    return centrality.path_statistics(_links(spark, sf_dir))


def g33_structural_holes(spark, sf_dir):
    return centrality.structural_holes(_links(spark, sf_dir))


def g35_metric_leaderboards(spark, sf_dir):
    """The ten documents that lead by each metric of the similarity graph."""
    links = _links(spark, sf_dir)
    degree = centrality.sides(links).groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    metrics = {"degree": degree, "betweenness": centrality.path_metrics(links), "pagerank": centrality.pagerank(links), "eigenvector": centrality.eigenvector(links)}
    return centrality.leaderboards({k: rows.select(rows.columns[0], F.round(rows.columns[1], 6).alias("value")) for k, rows in metrics.items()})


def g18_pagerank(spark, sf_dir):
    return centrality.pagerank(_links(spark, sf_dir))


def g18_clustering(spark, sf_dir):
    """Clustering of documents by weights, as shares of the greatest in their component."""
    links = _links(spark, sf_dir)
    part = connected_components(links, shared_folder(spark))
    most = links.join(part, links["u"] == part["node"]).groupBy("component").agg(F.max("w").alias("most"))
    found = centrality.clustering(links, part.join(most, "component").select("node", "most"))
    return found.select("node", F.round("clustering", 6).alias("clustering"))


def g19_label_propagation(spark, sf_dir):
    return centrality.label_propagation(_links(spark, sf_dir))


def g19_louvain(spark, sf_dir):
    return communities.louvain(_links(spark, sf_dir), shared_folder(spark))


def g19_greedy(spark, sf_dir):
    return communities.greedy(_links(spark, sf_dir), shared_folder(spark))


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations with their sources, as ``citations`` takes them."""

    def sources(cited: str, kind: str, title: str, page: str) -> str:
        fields = f"'source_type', {kind}, 'citation', {cited}, 'title', {title}, 'url', CAST(NULL AS STRING), 'page', {page}, 'quote', CAST(NULL AS STRING)"
        return f"CASE WHEN {cited} IS NOT NULL THEN array(named_struct({fields})) END AS sources"

    entities = _sql(spark, sf_dir, f"SELECT nr, name, type, description, {sources('citation', repr('government_record'), 'citation', 'CAST(NULL AS STRING)')} FROM described")
    relations = _sql(spark, sf_dir, f"SELECT nr, source_entity, target_entity, type, confidence, notes, {sources('citation', 'source_type', repr('Folder ') + ' || citation', 'page')} FROM claims")
    return entities, relations


def g30_cited_graph(spark, sf_dir):
    """The relations of the loaded graph with the types of both ends and the number of their sources and pages."""
    made = citations.load(*_cited(spark, sf_dir), on_invalid="leave")
    counts = made["relation_sources"].groupBy(*citations.RELATION).agg(F.count(F.lit(1)).alias("n_sources"), F.min("page").alias("first_page"))
    ends = made["entities"].select("name", F.col("type").alias("kind"), (F.col("description") == citations.PENDING).alias("pending"))
    a, b = (ends.select(F.col("name").alias(end), F.col("kind").alias(f"{end}_type"), F.col("pending").alias(f"{end}_pending")) for end in ("source_entity", "target_entity"))
    return made["relations"].join(counts, citations.RELATION).join(a, "source_entity").join(b, "target_entity")


def g30_cited_sources(spark, sf_dir):
    return citations.load(*_cited(spark, sf_dir), on_invalid="leave")["sources"].select("citation", "source_type", "title")


def g31_invalid_relations(spark, sf_dir):
    return citations.problems(*_cited(spark, sf_dir))


def g32_citation_report(spark, sf_dir):
    return citations.report(citations.load(*_cited(spark, sf_dir), on_invalid="take"))


#: Settings of the labels: what combinations of terms stand for, terms that say nothing, and the name that all share.
LABEL_RULES = {"Plain English": [["the", "and"], ["the", "of"], ["the", "is"]], "German": [["der", "die"], ["die"]], "French": [["les", "des"], ["le", "la"]]}
LABEL_SKIP = ("it", "in", "to", "page")
LABEL_KNOWN = ("Is",)


def g22_community_labels(spark, sf_dir):
    """Communities with their label, dates, and the names and terms that they are told by, in one text each."""
    members = _sql(spark, sf_dir, "SELECT node, community FROM members")
    entities = _sql(spark, sf_dir, "SELECT c.doc_id AS node, n.name_string AS name, n.occurrence_count AS mentions FROM names n JOIN catalog c ON n.file_path = c.path")
    terms = _sql(spark, sf_dir, "SELECT doc_id AS node, term, tf AS n FROM tdm")
    dates = _sql(spark, sf_dir, f"SELECT c.doc_id AS node, CAST({Spark().to_ts('date_string')} AS DATE) AS day FROM dates t JOIN catalog c ON t.file_path = c.path")
    found = labels.describe(members, entities, terms, dates, LABEL_RULES, set(LABEL_SKIP), set(LABEL_KNOWN))
    told = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws("=", x[a], x[b].cast("string"))), ",")
    return found.select("community", "size", told("top_entities", "name", "mentions").alias("names"), told("top_terms", "term", "n").alias("terms"), "start_date", "end_date", "label")


def s11_export_files(spark, sf_dir):
    """The rows in each folder of an export, counted in its files."""
    folder = passing(spark, f"{shared_folder(spark)}/export-{uuid.uuid4().hex}")
    key = F.element_at(F.split("file", "/"), 2)
    return export(spark, sf_dir, folder).groupBy("kind", key.alias("folder")).agg(F.sum("n_rows").alias("n_rows"))


def e3_recognised_entities(spark, sf_dir):
    """Persons and places of the captions by a recogniser of two patterns; any other is plugged in alike."""
    found = recognition.patterns({"PERSON": r"PHOTOGRAPHER +([^\n]+)", "GPE": r"  Location +([^\n]+)"})
    return recognition.entities(_sql(spark, sf_dir, "SELECT file_path, text FROM captions"), found)


def x5_phonetic_codes(spark, sf_dir):
    """(variant, first, second): codes of each form of a name, joined by a space."""
    d = Spark()
    rows = _sql(spark, sf_dir, f"SELECT DISTINCT variant, {names.normalised(d, 'variant')} AS plain FROM variants")
    return rows.withColumn("c", codes("plain")).select("variant", F.array_join("c.first", " ").alias("first"), F.array_join("c.second", " ").alias("second"))


def x32_openers(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT doc_id, text FROM docs").select("doc_id", opener(F.trim("text")).alias("opener"))


def g9_h1_persistence(spark, sf_dir):
    return cycles.h1_persistence(_links(spark, sf_dir), shared_folder(spark))


def g13_threshold_vote(spark, sf_dir):
    vertices = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    return thresholds.candidates(_links(spark, sf_dir), vertices, shared_folder(spark))


def g18_eigenvector(spark, sf_dir):
    return centrality.eigenvector(_links(spark, sf_dir))


QUERIES = {f.__name__: f for f in (x5_phonetic_codes, x32_openers, g9_h1_persistence, g13_threshold_vote, g18_eigenvector, s9_upsert, x2_osa_distance, x3_hamming_columns, x29_token_positions, j4_unordered_pairs, g8_h0_persistence, g10_betti_curve, g15_connected_components, g16_component_degree, g21_community_edges, g17_path_metrics, g23_bridges, g18_pagerank, g18_clustering, g19_label_propagation, g19_louvain, g19_greedy, g33_path_statistics, g33_structural_holes, g35_metric_leaderboards, e3_recognised_entities, g30_cited_graph, g30_cited_sources, g31_invalid_relations, g32_citation_report, g22_community_labels, s11_export_files)}

_CHECK = Check()
_SOUND_CLAIMS = "(SELECT * FROM claims WHERE citation IS NOT NULL AND confidence BETWEEN 0 AND 1)"
_SOUND_ENTITIES = "(SELECT * FROM described WHERE description <> '' AND citation IS NOT NULL)"
_COMPANY_TYPES = ", ".join(f"'{t}'" for t in citations.COMPANY_TYPES)
_COMBOS = ", ".join(f"({i}, {j}, '{name}', [{', '.join(repr(t) for t in combo)}])" for i, (name, combos) in enumerate(LABEL_RULES.items()) for j, combo in enumerate(combos))
_LISTED = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
SQL = {
    "g22_community_labels": f"""WITH RECURSIVE nt AS (SELECT community, name, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, name) AS rn FROM (SELECT m.community, n.name_string AS name, CAST(sum(n.occurrence_count) AS BIGINT) AS n FROM names n JOIN catalog c ON n.file_path = c.path JOIN members m ON c.doc_id = m.node GROUP BY 1, 2) a),
        tt AS (SELECT community, term, n, row_number() OVER (PARTITION BY community ORDER BY n DESC, term) AS rn FROM (SELECT m.community, t.term, CAST(sum(t.tf) AS BIGINT) AS n FROM tdm t JOIN members m ON t.doc_id = m.node GROUP BY 1, 2) a),
        ns AS (SELECT community, list(name ORDER BY rn) AS ns, string_agg(name || '=' || n, ',' ORDER BY rn) AS names FROM nt WHERE rn <= 10 GROUP BY community), ts AS (SELECT community, list(term ORDER BY rn) AS ts, string_agg(term || '=' || n, ',' ORDER BY rn) AS terms FROM tt WHERE rn <= 10 GROUP BY community),
        ds AS (SELECT m.community, CAST(min(try_strptime(t.date_string, '%m/%d/%Y')) AS DATE) AS a, CAST(max(try_strptime(t.date_string, '%m/%d/%Y')) AS DATE) AS z FROM dates t JOIN catalog c ON t.file_path = c.path JOIN members m ON c.doc_id = m.node GROUP BY 1),
        base AS (SELECT g.community, g.size, coalesce(ns, []) AS ns, coalesce(names, '') AS names, coalesce(ts, []) AS ts, coalesce(terms, '') AS terms, a, z, CASE WHEN ns IS NULL THEN [] WHEN list_contains({_LISTED(LABEL_KNOWN)}, ns[1]) THEN ns[2:2] ELSE ns[1:1] END AS lead
        FROM (SELECT community, count(*) AS size FROM members GROUP BY 1) g LEFT JOIN ns ON g.community = ns.community LEFT JOIN ts ON g.community = ts.community LEFT JOIN ds ON g.community = ds.community),
        hits AS (SELECT community, i, name, arg_min(combo, j) AS combo, max(3 - len(lead)) AS room FROM base JOIN (VALUES {_COMBOS}) AS r(i, j, name, combo) ON len(list_intersect(combo, ts)) = len(combo) GROUP BY community, i, name),
        used AS (SELECT community, list(name ORDER BY i) AS rules, flatten(list(combo)) AS gone FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY i) AS k FROM hits) h WHERE k <= room GROUP BY community)
        SELECT community, size, names, terms, a AS start_date, z AS end_date, CASE WHEN len(parts) = 0 THEN 'Community ' || community ELSE array_to_string(parts[1:3], ' / ') END AS label FROM (SELECT b.*, flatten([lead, coalesce(rules, []), list_transform(list_filter(ts[1:5], lambda t: NOT list_contains(list_concat(coalesce(gone, []), {_LISTED(LABEL_SKIP)}), t)),
        lambda t: upper(substr(t, 1, 1)) || substr(t, 2)), CASE WHEN a IS NULL THEN [] ELSE [CAST(year(a) AS VARCHAR)] END]) AS parts FROM base b LEFT JOIN used u ON b.community = u.community) f""",
    "s11_export_files": f"""WITH RECURSIVE grid AS (SELECT k, CAST(k / 20.0 AS DECIMAL(3, 2)) AS t FROM (SELECT unnest(generate_series(2, 19)) AS k) g)
        SELECT 'edges' AS kind, 'threshold=' || CAST(t AS STRING) AS folder, count(*) AS n_rows FROM links JOIN grid ON round(w * 20, 5) >= k GROUP BY t
        UNION ALL SELECT 'nodes', 'threshold=' || CAST(t AS STRING), count(DISTINCT node) FROM (SELECT u AS node, w FROM links UNION ALL SELECT v, w FROM links) s JOIN grid ON round(w * 20, 5) >= k GROUP BY t
        UNION ALL SELECT 'periods', 'period=' || label, count(DISTINCT file_path) FROM dates JOIN ({PERIODS}) AS p(id, label, lo, hi) ON CAST(right(date_string, 4) AS INT) BETWEEN lo AND hi GROUP BY label
        UNION ALL SELECT 'periods', 'period=all', count(*) FROM documents UNION ALL SELECT 'documents', 'chunk=' || CAST(CAST(floor(doc_id / CAST({CHUNK} AS DOUBLE)) AS BIGINT) AS STRING), count(*) FROM documents GROUP BY 2
        UNION ALL SELECT 'overlays', 'chunk=' || left(file_path, 4), count(*) FROM canonical GROUP BY 2 UNION ALL SELECT 'relations', 'type=' || type, count(*) FROM relations GROUP BY type""",
    "g30_cited_graph": f"""WITH RECURSIVE sound AS {_SOUND_CLAIMS}, ends AS (SELECT name, arg_max(type, nr) AS kind, false AS pending FROM {_SOUND_ENTITIES} e GROUP BY name
        UNION ALL SELECT name, arg_min(kind, nr * 2 + side), true FROM (SELECT source_entity AS name, nr, 0 AS side, 'person' AS kind FROM sound UNION ALL SELECT target_entity, nr, 1, CASE WHEN type IN ({_COMPANY_TYPES}) THEN 'company' ELSE 'person' END FROM sound) h
        WHERE name NOT IN (SELECT name FROM {_SOUND_ENTITIES} e) GROUP BY name)
        SELECT r.source_entity, r.target_entity, r.type, r.confidence, r.notes, l.n_sources, l.first_page, a.kind AS source_entity_type, a.pending AS source_entity_pending, b.kind AS target_entity_type, b.pending AS target_entity_pending
        FROM (SELECT source_entity, target_entity, type, arg_max(confidence, nr) AS confidence, arg_max(notes, nr) AS notes FROM sound GROUP BY 1, 2, 3) r
        JOIN (SELECT source_entity, target_entity, type, count(*) AS n_sources, min(page) AS first_page FROM (SELECT source_entity, target_entity, type, citation, arg_min(page, nr) AS page FROM sound GROUP BY 1, 2, 3, 4) s GROUP BY 1, 2, 3) l
        ON r.source_entity = l.source_entity AND r.target_entity = l.target_entity AND r.type = l.type JOIN ends a ON r.source_entity = a.name JOIN ends b ON r.target_entity = b.name""",
    "g30_cited_sources": f"SELECT citation, min(source_type) AS source_type, min(title) AS title FROM (SELECT citation, source_type, 'Folder ' || citation AS title FROM {_SOUND_CLAIMS} c UNION SELECT citation, 'government_record', citation FROM {_SOUND_ENTITIES} e) s GROUP BY citation",
    "g31_invalid_relations": """SELECT 'entity' AS kind, nr, name AS subject, 'no description' AS problem FROM described WHERE description = '' UNION ALL SELECT 'entity', nr, name, 'no description sources' FROM described WHERE citation IS NULL
        UNION ALL SELECT 'relation', nr, source_entity || ' -> ' || target_entity, 'no sources' FROM claims WHERE citation IS NULL UNION ALL SELECT 'relation', nr, source_entity || ' -> ' || target_entity, 'invalid confidence score' FROM claims WHERE confidence > 1""",
    "g32_citation_report": """WITH RECURSIVE cited AS (SELECT source_entity || ' --[' || type || ']--> ' || target_entity AS name, source_entity, target_entity, type, count(DISTINCT citation) AS n FROM claims GROUP BY source_entity, target_entity, type)
        SELECT 'source type' AS section, source_type AS name, count(DISTINCT citation) AS n FROM (SELECT source_type, citation FROM claims UNION ALL SELECT 'government_record', citation FROM described) s WHERE citation IS NOT NULL GROUP BY source_type
        UNION ALL SELECT 'most cited', name, n FROM (SELECT * FROM cited ORDER BY n DESC, source_entity, target_entity, type LIMIT 10) t UNION ALL SELECT 'without source', '', count(*) FROM cited WHERE n = 0""",
    "e3_recognised_entities": f"""SELECT file_path, kind, entity, count(*) AS occurrence_count FROM (SELECT file_path, 'name' AS kind, {names.clean_name(_CHECK, 'span')} AS entity FROM (SELECT file_path, {_CHECK.each(_CHECK.rx_groups('text', 'PHOTOGRAPHER +([^' + chr(92) + 'n]+)'))} AS span FROM captions) a
        UNION ALL SELECT file_path, 'location', {names.clean_place(_CHECK, 'span')} FROM (SELECT file_path, {_CHECK.each(_CHECK.rx_groups('text', '  Location +([^' + chr(92) + 'n]+)'))} AS span FROM captions) b) t
        WHERE entity <> '' AND CASE WHEN kind = 'name' THEN {names.valid_name(_CHECK, 'entity')} ELSE {names.valid_place(_CHECK, 'entity')} END GROUP BY file_path, kind, entity""",
    "s9_upsert": "SELECT coalesce(a.v1, b.v1) AS v1, coalesce(a.v2, b.v2) AS v2, round(greatest(a.similarity, b.similarity), 6) AS similarity, least(a.dist, b.dist) AS dist FROM (SELECT * FROM queue WHERE dist <= 3) a FULL OUTER JOIN (SELECT v1, v2, similarity * CAST(0.9 AS DOUBLE) AS similarity, dist + 1 AS dist FROM queue WHERE dist >= 2) b ON a.v1 = b.v1 AND a.v2 = b.v2",
    "x3_hamming_columns": "SELECT v1, v2, CAST(len(list_filter(generate_series(1, least(length(v1), length(v2))), lambda i: substr(v1, i, 1) <> substr(v2, i, 1))) + abs(length(v1) - length(v2)) AS BIGINT) AS dist FROM queue",
    "g15_connected_components": "WITH RECURSIVE e AS (SELECT u, v FROM links UNION SELECT v, u FROM links), r AS (SELECT u AS node, u AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u) SELECT node, min(reached) AS component FROM r GROUP BY node",
    "g18_clustering": """WITH RECURSIVE e AS (SELECT u, v FROM links UNION SELECT v, u FROM links), r AS (SELECT u AS node, u AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON r.reached = e.u), part AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
        most AS (SELECT component, max(w) AS most FROM links JOIN part ON u = node GROUP BY component), corners AS (SELECT unnest([x.u, x.v, y.v]) AS node, cbrt(x.w * y.w * z.w) AS m FROM links x JOIN links y ON x.v = y.u JOIN links z ON z.u = x.u AND z.v = y.v)
        SELECT k.u AS node, round(CASE WHEN k.n > 1 THEN 2.0 * coalesce(t.m, 0) / most.most / CAST(k.n * (k.n - 1) AS DOUBLE) ELSE 0 END, 6) AS clustering FROM (SELECT u, count(*) AS n FROM e GROUP BY u) k JOIN part ON k.u = part.node JOIN most ON part.component = most.component LEFT JOIN (SELECT node, sum(m) AS m FROM corners GROUP BY node) t ON k.u = t.node""",
    "g10_betti_curve": "WITH RECURSIVE grid AS (SELECT round(0.1 + i * CAST(0.05 AS DOUBLE), 2) AS threshold FROM (SELECT unnest(generate_series(0, 17)) AS i) g), e AS (SELECT threshold, u, v FROM links JOIN grid ON w >= threshold UNION SELECT threshold, v, u FROM links JOIN grid ON w >= threshold), n AS (SELECT threshold, doc_id AS node FROM documents, grid), r AS (SELECT threshold, node, node AS reached FROM n UNION SELECT r.threshold, r.node, e.v FROM r JOIN e ON r.reached = e.u AND r.threshold = e.threshold), c AS (SELECT threshold, count(DISTINCT m) AS b FROM (SELECT threshold, node, min(reached) AS m FROM r GROUP BY threshold, node) x GROUP BY threshold), k AS (SELECT grid.threshold, count(w) AS n FROM grid LEFT JOIN links ON w >= grid.threshold GROUP BY grid.threshold) SELECT k.threshold, c.b AS betti_0, k.n - (SELECT count(*) FROM documents) + c.b AS betti_1, k.n AS num_edges FROM k JOIN c ON k.threshold = c.threshold",
}

"""Queries over order and identity: numbered outlines, claims that share a sentence, paths through the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalog.operators import graph, order
from stratalog.operators.consolidate import anchored, consolidate
from stratalog.plans.knowledge import FIRST, IMPACT, _first
from stratalog.plans.registry import query

SEEN = ", ".join(f"sum((level = {k})::INT) OVER w AS seen{k}" for k in range(1, 7))
NUMBERS = ", ".join(f"seen{k} - coalesce(max(CASE WHEN level BETWEEN 1 AND {k - 1} THEN seen{k} END) OVER w, 0)" for k in range(1, 7))


@query("section_outline", f"""WITH RECURSIVE lines AS (SELECT document_id, ordinal, length(text) % 7 AS level FROM lake_blocks),
seen AS (SELECT *, {SEEN}, sum((level = 0)::INT) OVER w AS plain FROM lines WINDOW w AS (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
counted AS (SELECT *, [{NUMBERS}] AS numbers, plain - coalesce(max(CASE WHEN level > 0 THEN plain END) OVER w, 0) AS p, coalesce(last_value(nullif(level, 0) IGNORE NULLS) OVER w, 0) AS depth
  FROM seen WINDOW w AS (PARTITION BY document_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING)),
named AS (SELECT *, '§' || array_to_string([greatest(x, 1)::BIGINT FOR x IN numbers[1:depth]], '.') AS head FROM counted)
SELECT document_id, ordinal, CASE WHEN level > 0 THEN head WHEN depth > 0 THEN head || ' ¶' || p::BIGINT ELSE '¶' || p::BIGINT END AS locator FROM named""")
def section_outline(lake):
    """Numbers of every line, those of each length modulo seven taken as headings of that level."""
    lines = lake.blocks.select("document_id", "ordinal", (F.length("text") % 7).alias("level"))
    return order.locators(lines).select("document_id", "ordinal", "locator")


#: Each claim quotes two sentences: its own, and one of few that several claims of a document share.
QUOTES = "[substr(quote, 1, 12), array_to_string([document, (ordinal // 3 % 40)::VARCHAR], ' ')]"
ANCHORS = rf"""claims AS (SELECT *, {QUOTES} AS quotes FROM lake_claims),
cited AS (SELECT ordinal, document, unnest(range(2)) AS place, regexp_replace(trim(regexp_replace(translate(lower(unnest(quotes)), 'čćžšđ', 'cczsd'), '\s+', ' ', 'g')), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS q FROM claims),
owners AS (SELECT document, q, min(ordinal) AS owner FROM cited GROUP BY ALL),
links AS (SELECT ordinal, arg_min(owner, place) AS parent FROM cited JOIN owners USING (document, q) WHERE owner < ordinal GROUP BY ordinal),
walk AS (SELECT ordinal, ordinal AS root FROM lake_claims UNION ALL SELECT w.ordinal, l.parent FROM walk w JOIN links l ON l.ordinal = w.root),
roots AS (SELECT ordinal, min(root) AS root FROM walk GROUP BY ordinal),
keyed AS (SELECT c.* EXCLUDE (key), r.key FROM claims c JOIN roots USING (ordinal) JOIN lake_claims r ON r.ordinal = root)"""


def _anchored(lake):
    shared = F.concat_ws(" ", "document", (F.floor(F.col("ordinal") / 3) % 40).cast("string"))
    return anchored(lake.claims.withColumn("quotes", F.array(F.substring("quote", 1, 12), shared)))


@query("quote_anchors", f"WITH RECURSIVE {ANCHORS} SELECT ordinal, key FROM keyed")
def quote_anchors(lake):
    """The key that each claim is grouped under: that of the earliest claim it shares a sentence with, over any steps."""
    return _anchored(lake).select("ordinal", "key")


@query("anchored_groups", f"WITH RECURSIVE {ANCHORS} SELECT key AS id, arg_max(title, (modified, -ordinal)) AS title, arg_max(kind, (modified, -ordinal)) AS kind, count(*) AS n_claims, count(DISTINCT document) AS n_evidence FROM keyed GROUP BY key")
def anchored_groups(lake):
    return consolidate(_anchored(lake)).select("id", "title", "kind", "n_claims", "n_evidence")


PATHS = """WITH RECURSIVE e AS ({e}), walk AS (SELECT {start} AS node, 0 AS distance UNION SELECT e.{b}, distance + 1 FROM walk JOIN e ON e.{a} = walk.node WHERE distance < 40),
best AS (SELECT node, min(distance)::BIGINT AS distance FROM walk GROUP BY node),
parents AS (SELECT b.node, b.distance, min(e.{a}) AS parent FROM best b JOIN e ON e.{b} = b.node JOIN best p ON p.node = e.{a} AND p.distance = b.distance - 1 WHERE b.distance > 0 GROUP BY ALL),
back AS (SELECT node, distance, parent AS above, node AS path FROM parents UNION ALL SELECT b.node, b.distance, p.parent, b.above || ' > ' || b.path FROM back b LEFT JOIN parents p ON p.node = b.above WHERE b.above IS NOT NULL)
SELECT node, distance, path FROM back WHERE above IS NULL"""


@query("impact_paths", PATHS.format(e=IMPACT, start=FIRST, a="src", b="dst"))
def impact_paths(lake):
    """What a change of the first object reaches, and on which way."""
    reached = graph.reach_with_parents(graph.impact_edges(lake.relations), _first(lake))
    return graph.paths(reached).select("node", "distance", F.array_join("path", " > ").alias("path"))


@query("foundation_paths", PATHS.format(e=IMPACT, start="(SELECT max(id) FROM lake_objects)", a="dst", b="src"))
def foundation_paths(lake):
    """What the last object rests on, and on which way."""
    turned = graph.impact_edges(lake.relations).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = graph.reach_with_parents(turned, lake.objects.agg(F.max("id").alias("start")))
    return graph.paths(reached).select("node", "distance", F.array_join("path", " > ").alias("path"))

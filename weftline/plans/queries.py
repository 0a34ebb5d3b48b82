"""Every operator as a query over the standard tables, with SQL that gives the same rows.

Documents stand for episodes (lines are split at newlines, characters count as time), conversations for
transcripts, labels for classes, capitalised words for names, embeddings for sentence vectors.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators import classify, dialogue, graph, memory, mentions, names, network, neural, themes, topics, training, vectors
from weftline.session import cut, spread
from weftline.sources import wikitext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Arcs over document and conversation ids.
ARCS = [(0, 99, "first"), (100, 299, "second"), (300, 599, "third"), (600, 999, "fourth")]
LABELS = ["the", "tion", "batt", "erst"]
BUDGET = 320


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str, timed: bool = False) -> DataFrame:
    return dialogue.document_lines(spread(table(spark, sf, "documents").select("doc_id", "text")), timed=timed)


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("episode"), F.col("turn").alias("line_idx"), "role", "text")


LINES = """lines AS (SELECT doc_id AS episode, unnest(range(len(p))) AS line_idx, unnest(p) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
timed AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY episode ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS start FROM lines)"""
SQUEEZE = lambda c: f"trim(regexp_replace({c}, '{X.SPACE_RE2}+', ' ', 'g'))"
WORDS = lambda c: f"(CASE WHEN length({SQUEEZE(c)}) = 0 THEN 0 ELSE length({SQUEEZE(c)}) - length(replace({SQUEEZE(c)}, ' ', '')) + 1 END)"
ARC = lambda c: "CASE " + " ".join(f"WHEN {c} BETWEEN {a} AND {b} THEN '{n}'" for a, b, n in ARCS) + " ELSE 'Unknown' END"
STRAIGHT = lambda c: f"translate({c}, '’‘“”', '''''\"\"')"


# -- text functions


@query(f"WITH {LINES} SELECT episode, line_idx, {SQUEEZE(STRAIGHT('''regexp_replace(replace(replace(replace(regexp_replace(text, '\\{[^}]*\\}', '', 'g'), '\\N', ' '), '\\n', ' '), '\\h', ' '), '<[^>]+>', '', 'g')'''))} AS text FROM lines")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).select("episode", "line_idx", X.clean_text(F.col("text")).alias("text"))


@query(f"SELECT conv_id, turn, trim(regexp_replace({STRAIGHT('''regexp_replace(text, '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g')''')}, '{X.SPACE_RE2}+', ' ', 'g'), ' -') AS line FROM conversations")
def stage_strip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", X.clean_line(F.col("text")).alias("line"))


@query(f"WITH {LINES}, n AS (SELECT episode, line_idx, trim(regexp_replace(lower(text), '[^a-z'' ]', '', 'g')) AS norm FROM lines) SELECT episode, line_idx, norm, CAST(length(norm) - length(replace(norm, ' ', '')) AS INTEGER) AS n_spaces FROM n")
def lyric_norm(spark: SparkSession, sf: str) -> DataFrame:
    norm = X.lyric_norm(F.col("text"))
    return lines(spark, sf).select("episode", "line_idx", norm.alias("norm"), X.spaces(norm).alias("n_spaces"))


@query(f"SELECT conv_id, turn, CAST({WORDS('text')} AS INTEGER) AS words FROM conversations WHERE {WORDS('text')} >= 4")
def min_words(spark: SparkSession, sf: str) -> DataFrame:
    words = X.word_count(F.col("text"))
    return table(spark, sf, "conversations").filter(words >= 4).select("conv_id", "turn", words.alias("words"))


@query("SELECT conv_id, turn, text FROM conversations WHERE regexp_matches(text, '(?i)\\bthe that\\b|\\bla de\\b')")
def signature_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").filter(F.col("text").rlike(r"(?iu)\bthe that\b|\bla de\b")).select("conv_id", "turn", "text")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'Brass' WHEN contains(lower(p_type), 'steel') THEN 'Steel' WHEN contains(lower(p_type), 'tin') THEN 'Tin' END AS label FROM part")
def label_priority(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", X.primary_label(F.split("p_type", " "), ["Brass", "Steel", "Tin"]).alias("label"))


@query("SELECT p_partkey, array_to_string(list_distinct_ordered, '|') AS classes FROM (SELECT p_partkey, [x FOR x IN [trim(y) FOR y IN string_split(replace(p_type, ' ', ','), ',')] IF x <> ''] AS list_distinct_ordered FROM part)")
def schema_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.when(F.col("p_partkey") % 2 == 0, F.split("p_type", " "))
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.classes_of(listed, F.replace("p_type", F.lit(" "), F.lit(","))), "|").alias("classes"))


@query("SELECT page_id, 'https://wiki.example/wiki/' || replace(replace(url_encode(replace(url, ' ', '_')), '%2F', '/'), '%7E', '~') AS address FROM pages")
def wiki_address(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", X.article_url("https://wiki.example", F.col("url")).alias("address"))


# -- dialogue


REPEATED = f"""WITH {LINES}, n AS (SELECT *, start + length(text) AS "end", trim(regexp_replace(lower(text), '[^a-z'' ]', '', 'g')) AS norm FROM timed),
spread AS (SELECT norm FROM n GROUP BY norm HAVING count(DISTINCT episode) >= 5), d AS (SELECT episode, max("end") AS duration FROM n GROUP BY episode)
SELECT n.episode, line_idx, (norm IN (SELECT norm FROM spread) AND length(norm) - length(replace(norm, ' ', '')) >= 2 AND (start <= 150 OR start >= duration - 150)) AS is_song FROM n JOIN d USING (episode)"""


@query(REPEATED)
def repeated_line_flag(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.flag_repeated(lines(spark, sf, timed=True)).select("episode", "line_idx", "is_song")


@query(f"SELECT episode, arc, count(*) AS n_lines, min(line_idx) AS first_line FROM (SELECT episode, line_idx, {ARC('episode')} AS arc FROM ({REPEATED}) WHERE NOT is_song) GROUP BY ALL")
def dialogue_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept = dialogue.with_arc(dialogue.flag_repeated(lines(spark, sf, timed=True)).filter("not is_song"), ARCS)
    return kept.groupBy("episode", "arc").agg(F.count("*").alias("n_lines"), F.min("line_idx").cast("long").alias("first_line"))


@query(f"SELECT doc_id, {ARC('doc_id')} AS arc FROM documents")
def arc_range_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id")
    return dialogue.with_arc_join(docs, dialogue.arc_table(spark, ARCS), "doc_id")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS script FROM conversations GROUP BY conv_id")
def episode_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.scripts(table(spark, sf, "conversations"), ["conv_id"], "turn")


@query("SELECT conv_id, turn, lag(role) OVER w AS prev_role, lag(text) OVER w AS prev_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_turn(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.with_previous(table(spark, sf, "conversations"), ["conv_id"], "turn", {"role": "prev_role", "text": "prev_text"}).select("conv_id", "turn", "prev_role", "prev_text")


@query(f"SELECT conv_id, turn, coalesce(prev, '') AS context, text AS line FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE role = 'assistant' AND {WORDS('text')} >= 4")
def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    before = dialogue.with_previous(table(spark, sf, "conversations"), ["conv_id"], "turn", {"text": "context"}, "")
    return before.filter((F.col("role") == "assistant") & (X.word_count(F.col("text")) >= 4)).select("conv_id", "turn", "context", F.col("text").alias("line"))


@query("SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def keep_first_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dialogue.keep_first(docs, [F.sha2(F.col("text").cast("binary"), 256)], ["doc_id"])


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS first_of_source FROM documents")
def first_of_group(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("first_of_source"))
    return docs.join(F.broadcast(first) if first.count() <= 100_000 else first, "source").select("doc_id", "first_of_source")


# -- themes


CHUNKS = f"""WITH RECURSIVE {LINES}, sized AS (SELECT episode, line_idx, text, CAST({WORDS('text')} AS BIGINT) AS n FROM lines),
packed AS (SELECT episode, line_idx, text, n, 0::BIGINT AS chunk_id, n AS size FROM sized WHERE line_idx = 0
  UNION ALL SELECT s.episode, s.line_idx, s.text, s.n, p.chunk_id + CASE WHEN p.size + s.n > {BUDGET} THEN 1 ELSE 0 END, CASE WHEN p.size + s.n > {BUDGET} THEN s.n ELSE p.size + s.n END
  FROM packed p JOIN sized s ON s.episode = p.episode AND s.line_idx = p.line_idx + 1),
chunks AS (SELECT episode, chunk_id, string_agg(text, ' ' ORDER BY line_idx) AS text, sum(n) AS tokens, count(*) AS n_lines FROM packed GROUP BY episode, chunk_id)"""


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return themes.chunks(lines(spark, sf), BUDGET)


@query(f"{CHUNKS} SELECT episode, chunk_id, CAST(tokens AS BIGINT) AS tokens, n_lines, text FROM chunks")
def greedy_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_rows(spark, sf).select("episode", F.col("chunk_id").cast("long").alias("chunk_id"), "tokens", F.col("n_lines").cast("long").alias("n_lines"), "text")


SCORED = f"""{CHUNKS}, labels_(theme) AS (VALUES {', '.join(f"('{x}')" for x in LABELS)}),
words AS (SELECT episode, chunk_id, text, [w FOR w IN regexp_split_to_array(lower(text), '[^a-z]+') IF w <> ''] AS w FROM chunks),
scored AS (SELECT episode, {ARC('episode')} AS arc, chunk_id, text, theme, CASE WHEN len(w) > 0 THEN len([x FOR x IN w IF starts_with(x, lower(theme[1:4]))]) / len(w) ELSE 0 END AS score FROM words, labels_),
episodes AS (SELECT episode, arc, theme, count(*) AS n_chunks, avg(score) AS score FROM scored GROUP BY ALL)"""


def scored_rows(spark: SparkSession, sf: str) -> DataFrame:
    return themes.score(dialogue.with_arc(chunk_rows(spark, sf), ARCS), themes.label_table(spark, LABELS))


def theme_rows(spark: SparkSession, sf: str) -> DataFrame:
    return themes.by_episode(scored_rows(spark, sf), ["episode", "arc"])


@query(f"{SCORED} SELECT episode, chunk_id, theme, round(score, 6) AS score FROM scored")
def theme_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored_rows(spark, sf).select("episode", F.col("chunk_id").cast("long").alias("chunk_id"), "theme", F.round("score", 6).alias("score"))


@query(f"{SCORED} SELECT episode, arc, theme, n_chunks, round(score, 6) AS score FROM episodes")
def theme_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return theme_rows(spark, sf).withColumn("score", F.round("score", 6))


@query(f"{SCORED} SELECT theme, round(avg(score), 6) AS score, round(avg(score) / max(avg(score)) OVER (), 6) AS relative FROM episodes GROUP BY theme")
def series_profile(spark: SparkSession, sf: str) -> DataFrame:
    return themes.profile(theme_rows(spark, sf)).select("theme", F.round("score", 6).alias("score"), F.round("relative", 6).alias("relative"))


LIFT = f"""{SCORED}, lifts AS (SELECT arc, theme, avg(score) / (SELECT CASE WHEN avg(score) <> 0 THEN avg(score) END FROM episodes f WHERE f.theme = e.theme) AS lift FROM episodes e GROUP BY arc, theme)"""


@query(f"{LIFT} SELECT arc, theme, round(lift, 6) AS lift FROM lifts")
def arc_lift(spark: SparkSession, sf: str) -> DataFrame:
    return themes.lift(theme_rows(spark, sf)).select("arc", "theme", F.round("lift", 6).alias("lift"))


@query(f"{LIFT} SELECT round(max(abs(log2(lift))), 6) AS span FROM lifts WHERE lift > 0")
def lift_scale(spark: SparkSession, sf: str) -> DataFrame:
    return themes.lift_span(themes.lift(theme_rows(spark, sf))).select(F.round("span", 6).alias("span"))


@query(f"{SCORED} SELECT episode, chunk_id, text FROM scored WHERE theme = 'tion' ORDER BY score DESC, episode, chunk_id LIMIT 5")
def top_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return themes.excerpts(scored_rows(spark, sf), "tion", 5, ["episode", "chunk_id"]).select("episode", F.col("chunk_id").cast("long").alias("chunk_id"), "text")


@query()
def topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents against labels by seeded topics, which are fitted on all chunks."""
    chunked = cut(chunk_rows(spark, sf).select("episode", "chunk_id", "text"))
    found = topics.factorise(chunked, ["episode", "chunk_id"], LABELS)
    return topics.score(found, chunked.drop("text"), ["episode", "chunk_id"])


#: Labels and episodes of a question, as many of these as one may ask for.
ASKED, SPAN = [" chach", "reer ", "  "], (1, 20)


@query(f"""{CHUNKS}, labels_(theme) AS (VALUES ('chach'), ('reer')), words AS (SELECT episode, [w FOR w IN regexp_split_to_array(lower(text), '[^a-z]+') IF w <> ''] AS w FROM chunks WHERE episode BETWEEN {SPAN[0]} AND {SPAN[1]})
SELECT episode, theme, count(*) AS n_chunks, round(avg(CASE WHEN len(w) > 0 THEN len([x FOR x IN w IF starts_with(x, theme[1:4])]) / len(w) ELSE 0 END), 6) AS score FROM words, labels_ GROUP BY episode, theme""")
def asked_themes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of one's own over a range of episodes, blanks around labels and blank labels gone."""
    some = lines(spark, sf).filter(F.col("episode").isin(list(range(SPAN[0], SPAN[1] + 1))))
    scored = themes.score(themes.chunks(some, BUDGET), themes.label_table(spark, ASKED))
    return themes.by_episode(scored).withColumn("score", F.round("score", 6))


@query(f"{SCORED} SELECT episode, theme, round(avg(score) OVER (PARTITION BY theme ORDER BY episode ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS rolling FROM episodes")
def theme_rolling9(spark: SparkSession, sf: str) -> DataFrame:
    return themes.rolling(theme_rows(spark, sf)).select("episode", "theme", F.round("rolling", 6).alias("rolling"))


@query(f"""{SCORED} SELECT episode, arc, {', '.join(f"round(max(score) FILTER (theme = '{x}'), 6) AS {x}" for x in LABELS)} FROM episodes GROUP BY episode, arc""")
def theme_wide(spark: SparkSession, sf: str) -> DataFrame:
    return themes.wide(theme_rows(spark, sf), LABELS, ["episode", "arc"]).select("episode", "arc", *[F.round(x, 6).alias(x) for x in LABELS])


# -- mentions and networks


FOUND = f"""{LINES}, english AS (SELECT l.* FROM lines l JOIN documents d ON d.doc_id = l.episode WHERE d.lang = 'en'),
found AS (SELECT episode, line_idx, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]{{3,}})', 1)) AS character FROM english),
mentions AS (SELECT DISTINCT episode, {ARC('episode')} AS arc, line_idx, character FROM found WHERE lower(character) NOT IN ('this', 'that', 'with', 'from'))"""
STOP = ["this", "that", "with", "from"]


def mention_rows(spark: SparkSession, sf: str) -> DataFrame:
    english = dialogue.document_lines(spread(table(spark, sf, "documents").filter("lang = 'en'").select("doc_id", "text")))
    found = mentions.capitalised(english.select("episode", "line_idx", "text"), r"\b([A-Z][a-z]{3,})").select("episode", "line_idx", F.col("surface").alias("character"))
    kept = mentions.without_stop_words(found, mentions.stop_table(spark, STOP)).distinct()
    return dialogue.with_arc(kept, ARCS).select("episode", "arc", F.col("line_idx").cast("long").alias("line_idx"), "character")


@query(f"WITH {FOUND} SELECT episode, arc, line_idx, character FROM mentions")
def mention_table(spark: SparkSession, sf: str) -> DataFrame:
    return mention_rows(spark, sf)


@query(f"WITH {FOUND} SELECT character, count(*) AS n FROM mentions GROUP BY character HAVING count(*) >= 8")
def min_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return network.frequent(mention_rows(spark, sf), 8).groupBy("character").agg(F.count("*").alias("n"))


def edge_sql(where: str, least: int, arc: str = "") -> str:
    by = f"{arc}, " if arc else ""
    on = f" AND a.{arc} = b.{arc}" if arc else ""
    first = f"a.{arc}, " if arc else ""
    return f"""m AS (SELECT * FROM mentions {where}), kept AS (SELECT * FROM m WHERE ({by}character) IN (SELECT ({by}character) FROM m GROUP BY {by}character HAVING count(*) >= {least})),
edges AS (SELECT {first}a.character AS source, b.character AS target, sum(exp(-abs(a.line_idx - b.line_idx) / 4.0)) AS weight, count(*) AS cooccurrences, count(DISTINCT a.episode) AS episodes
  FROM kept a JOIN kept b ON a.episode = b.episode{on} AND abs(a.line_idx - b.line_idx) <= 10 AND a.character < b.character GROUP BY ALL)"""


ROUNDED = "source, target, round(weight, 6) AS weight, cooccurrences, episodes"


def rounded(links: DataFrame, *more: str) -> DataFrame:
    return links.select(*more, "source", "target", F.round("weight", 6).alias("weight"), F.col("cooccurrences").cast("long").alias("cooccurrences"), F.col("episodes").cast("long").alias("episodes"))


@query(f"WITH {FOUND}, {edge_sql('', 8)} SELECT {ROUNDED} FROM edges")
def network_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.network(mention_rows(spark, sf)))


@query(f"WITH {FOUND}, {edge_sql('WHERE arc = ' + chr(39) + 'second' + chr(39), 8)} SELECT {ROUNDED} FROM edges")
def network_of_arc(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.network(mention_rows(spark, sf), arc="second"))


@query(f"WITH {FOUND}, {edge_sql('', 3, 'arc')} SELECT arc, {ROUNDED} FROM edges")
def arc_networks(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.arc_networks(mention_rows(spark, sf)), "arc")


@query(f"WITH {FOUND}, {edge_sql('', 8)}, e AS (SELECT source AS a, weight FROM edges UNION ALL SELECT target, weight FROM edges) SELECT a AS character, count(*) AS degree, round(sum(weight), 5) AS strength FROM e GROUP BY a")
def degree_strength(spark: SparkSession, sf: str) -> DataFrame:
    return network.degrees(network.network(mention_rows(spark, sf))).select("character", "degree", F.round("strength", 5).alias("strength"))


@query(f"WITH {FOUND}, {edge_sql('', 8)} SELECT CASE WHEN source = 'Ther' THEN target ELSE source END AS character, episodes FROM edges WHERE source = 'Ther' OR target = 'Ther' ORDER BY weight DESC, 1 LIMIT 8")
def strongest_ties(spark: SparkSession, sf: str) -> DataFrame:
    return network.ties(network.network(mention_rows(spark, sf)), "Ther").select("character", "episodes")


@query(f"WITH {FOUND}, {edge_sql('', 8)} SELECT {ROUNDED} FROM edges ORDER BY edges.weight DESC, source, target LIMIT 250")
def top_edges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(network.strongest(network.network(mention_rows(spark, sf)), 250))


@query(f"WITH {FOUND}, {edge_sql('', 8)}, t AS (SELECT * FROM edges ORDER BY weight DESC, source, target LIMIT 250) SELECT source, target, round(0.5 + 6 * pow(weight / (SELECT max(weight) FROM t), 0.6), 6) AS width FROM t")
def edge_widths(spark: SparkSession, sf: str) -> DataFrame:
    return network.edge_styles(drawn(spark, sf)).select("source", "target", F.round("width", 6).alias("width"))


GRAPH = f"WITH RECURSIVE {FOUND}, {edge_sql('', 8)}, g AS MATERIALIZED (SELECT source, target, weight FROM edges), e AS MATERIALIZED (SELECT source AS a, target AS b, weight AS w FROM g UNION ALL SELECT target, source, weight FROM g)"


# what a page draws is the strongest links, and of these the largest component
DRAWN = GRAPH.replace(" FROM edges)", " FROM edges ORDER BY weight DESC, source, target LIMIT 250)")


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    return cut(network.strongest(network.network(mention_rows(spark, sf)), 250).select("source", "target", "weight"))


def whole(spark: SparkSession, sf: str) -> DataFrame:
    return cut(network.network(mention_rows(spark, sf)).select("source", "target", "weight"))


@query(f"""{GRAPH}, s AS MATERIALIZED (SELECT a, sum(w) AS s, (SELECT count(DISTINCT a) FROM e) AS n FROM e GROUP BY a),
r(k, a, r) AS (SELECT 0, a, 1.0::DOUBLE / n FROM s UNION ALL SELECT r.k + 1, e.b, 0.15 / max(s.n) + 0.85 * sum(r.r * e.w / s.s) FROM r JOIN e ON e.a = r.a JOIN s ON s.a = r.a WHERE r.k < 80 GROUP BY r.k, e.b)
SELECT a AS character, round(r, 6) AS pagerank FROM r WHERE k = 80""")
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(whole(spark, sf)).select("character", F.round("pagerank", 6).alias("pagerank"))


@query(f"""{GRAPH}, loops AS MATERIALIZED (SELECT * FROM e UNION ALL SELECT DISTINCT a, a, 1.0 FROM e),
v(k, a, x) AS (SELECT 0, a, 1.0::DOUBLE FROM (SELECT DISTINCT a FROM e) UNION ALL SELECT k, b, y / sqrt(sum(y * y) OVER ()) FROM (SELECT v.k + 1 AS k, l.b, sum(v.x * l.w) AS y FROM v JOIN loops l ON l.a = v.a WHERE v.k < 80 GROUP BY v.k, l.b))
SELECT a AS character, round(x, 6) AS eigenvector FROM v WHERE k = 80""")
def eigenvector(spark: SparkSession, sf: str) -> DataFrame:
    return graph.eigenvector(whole(spark, sf)).select("character", F.round("eigenvector", 6).alias("eigenvector"))


REACH = f"{GRAPH}, reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), parts AS (SELECT a AS character, min(b) AS component FROM reach GROUP BY a)"


@query(f"{REACH} SELECT character, component FROM parts")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(whole(spark, sf))


@query(f"{REACH.replace(GRAPH, DRAWN)}, best AS (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1), keep AS (SELECT character FROM parts WHERE component IN (SELECT component FROM best)) SELECT source, target, round(weight, 6) AS weight FROM g WHERE source IN (SELECT character FROM keep) AND target IN (SELECT character FROM keep)")
def largest_component(spark: SparkSession, sf: str) -> DataFrame:
    links = drawn(spark, sf)
    return network.induced(links, graph.largest_component(links)).withColumn("weight", F.round("weight", 6))


@query(f"{REACH} SELECT component, count(*) AS size FROM parts GROUP BY component ORDER BY size DESC, component LIMIT 100")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.component_sizes(graph.components(whole(spark, sf)))


@query(f"WITH {FOUND}, {edge_sql('', 8)}, e AS (SELECT source AS a, weight FROM edges UNION ALL SELECT target, weight FROM edges), s AS (SELECT a AS character, sum(weight) AS strength FROM e GROUP BY a) SELECT character, round(strength, 6) AS strength FROM s ORDER BY s.strength DESC, character LIMIT 22")
def labelled_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return network.labelled(network.degrees(network.network(mention_rows(spark, sf))), by="strength").select("character", F.round("strength", 6).alias("strength"))


@query()
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return graph.betweenness(whole(spark, sf)).select("character", F.round("betweenness", 6).alias("betweenness"))


@query()
def louvain(spark: SparkSession, sf: str) -> DataFrame:
    return graph.louvain(whole(spark, sf))


@query()
def network_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return network.node_styles(graph.metrics(whole(spark, sf), mention_rows(spark, sf)))


@query()
def community_top2(spark: SparkSession, sf: str) -> DataFrame:
    links = whole(spark, sf)
    return network.leaders(graph.louvain(links).join(graph.pagerank(links), "character"))


def name_aliases() -> list[tuple[str, str]]:
    return [("Ther", "Ther"), ("Ther An", "Ther"), ("Oner", "Oner"), ("Erst", "Erst"), ("Thereon", "Thereon")]


@query(f"""WITH {LINES}, found AS (SELECT episode, line_idx, unnest(regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}])(Thereon|Erst|Oner|Ther)', 1)) AS w FROM lines) SELECT DISTINCT episode, line_idx, w AS character FROM (
SELECT episode, line_idx, unnest([x FOR x IN regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+') IF x IN ('Thereon', 'Erst', 'Oner', 'Ther')]) AS w FROM lines)""")
def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    found = mentions.extract(lines(spark, sf).select("episode", F.col("line_idx").cast("long").alias("line_idx"), "text"), spark, aliases=name_aliases())
    return found.select("episode", "line_idx", "character")


@query()
def mention_model(spark: SparkSession, sf: str) -> DataFrame:
    """Names of all documents by a field fitted on phrases of the cast, with the gate of words that are commonly written small."""
    rows = cut(lines(spark, sf).select("episode", F.col("line_idx").cast("long").alias("line_idx"), "text"))
    counts = names.small_counts(rows)
    field = names.fit_on(rows, name_aliases(), counts=counts)
    found = mentions.extract(rows, spark, names.model(field), name_aliases(), cut(mentions.zipfs(counts)))
    return found.select("episode", "line_idx", "character", "source")


# -- labels


SEEDED = "md5('42:' || doc_id)"


@query(f"""WITH o AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {SEEDED}, doc_id) AS p, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN p <= floor(n * 0.15 + 0.5) THEN 'test' WHEN p <= 2 * floor(n * 0.15 + 0.5) THEN 'val' ELSE 'train' END AS split FROM o""")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return classify.stratified_split(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "quality", "split")


@query(f"SELECT doc_id, CAST((row_number() OVER (PARTITION BY quality ORDER BY {SEEDED}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def kfold_assign(spark: SparkSession, sf: str) -> DataFrame:
    return classify.folds(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "fold")


@query("SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels GROUP BY quality")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return classify.class_weights(table(spark, sf, "labels"), "quality").withColumn("weight", F.round("weight", 6))


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """A rule's predictions of quality: texts of more than 400 characters are good."""
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.length("text") > 400, "1").otherwise("0").alias("y_pred"), F.length("text").alias("n"))
    return table(spark, sf, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").cast("string").alias("y_true"), "y_pred", "n")


GRID = """p AS (SELECT CAST(quality AS VARCHAR) AS y_true, CASE WHEN length(text) > 400 THEN '1' ELSE '0' END AS y_pred, doc_id FROM labels JOIN documents USING (doc_id)),
matrix AS (SELECT a.x AS y_true, b.x AS y_pred, (SELECT count(*) FROM p WHERE p.y_true = a.x AND p.y_pred = b.x) AS n FROM (VALUES ('0'), ('1')) a(x), (VALUES ('0'), ('1')) b(x)),
per_class AS (SELECT l.x AS label, sum(n) FILTER (y_true = l.x AND y_pred = l.x) AS hit, sum(n) FILTER (y_pred = l.x) AS said, sum(n) FILTER (y_true = l.x) AS support FROM matrix, (VALUES ('0'), ('1')) l(x) GROUP BY l.x)"""


@query(f"WITH {GRID} SELECT y_true, y_pred, n FROM matrix")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return classify.confusion(predicted(spark, sf), ["0", "1"])


@query(f"WITH {GRID} SELECT label, round(CASE WHEN said > 0 THEN hit / said ELSE 0 END, 4) AS precision, round(CASE WHEN support > 0 THEN hit / support ELSE 0 END, 4) AS recall, round(CASE WHEN said + support > 0 THEN 2 * hit / (said + support) ELSE 0 END, 4) AS f1, CAST(support AS BIGINT) AS support FROM per_class")
def per_class_prf(spark: SparkSession, sf: str) -> DataFrame:
    return classify.per_class(classify.confusion(predicted(spark, sf), ["0", "1"])).select("label", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {GRID} SELECT round((SELECT avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) FROM p), 4) AS accuracy, round(avg(CASE WHEN said + support > 0 THEN 2 * hit / (said + support) ELSE 0 END), 4) AS macro_f1 FROM per_class")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    whole = classify.summary(predicted(spark, sf), ["0", "1"])
    return whole.select(F.round("accuracy", 4).alias("accuracy"), F.round("macro_f1", 4).alias("macro_f1"))


FOLD_SCORES = f"""f AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {SEEDED}, doc_id) - 1) % 5 AS fold FROM labels),
s AS (SELECT m.model, fold, avg(CASE WHEN (quality = 1) = (length(text) > m.least) THEN 1.0 ELSE 0.0 END) AS score FROM f JOIN documents USING (doc_id), (VALUES ('long', 400), ('short', 100)) m(model, least) GROUP BY ALL)"""


def fold_scores(spark: SparkSession, sf: str) -> DataFrame:
    dealt = classify.folds(table(spark, sf, "labels"), "doc_id", "quality").join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    rules = spark.createDataFrame([("long", 400), ("short", 100)], "model string, least int")
    right = ((F.col("quality") == 1) == (F.col("n") > F.col("least"))).cast("double")
    return dealt.crossJoin(F.broadcast(rules)).groupBy("model", "fold").agg(F.avg(right).alias("score"))  # two rules


@query(f"WITH {FOLD_SCORES} SELECT model, count(*) AS folds, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std FROM s GROUP BY model")
def cv_summary(spark: SparkSession, sf: str) -> DataFrame:
    return classify.fold_summary(fold_scores(spark, sf)).select("model", "folds", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query(f"WITH {FOLD_SCORES} SELECT round(avg(a.score - b.score), 4) AS mean, round(stddev_samp(a.score - b.score), 4) AS std, count(*) FILTER (a.score > b.score) AS folds_won FROM s a JOIN s b USING (fold) WHERE a.model = 'long' AND b.model = 'short'")
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return classify.paired(fold_scores(spark, sf), "long", "short").select(F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "folds_won")


@query(f"WITH {FOLD_SCORES}, m AS (SELECT model, avg(score) AS score FROM s GROUP BY model) SELECT model, round(score, 4) AS score, score = (SELECT max(score) FROM m) AS best FROM m")
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return classify.leaderboard(fold_scores(spark, sf)).select("model", F.round("score", 4).alias("score"), "best")


@query(f"""WITH f AS (SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY {SEEDED}, doc_id) - 1) % 5 AS own FROM labels),
x AS (SELECT *, unnest(range(5)) AS fold FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY fold, quality ORDER BY {SEEDED}, doc_id) AS p, count(*) OVER (PARTITION BY fold, quality) AS n FROM x WHERE own <> fold)
SELECT doc_id, CAST(fold AS INTEGER) AS fold, CASE WHEN p <= floor(n * 0.15 + 0.5) THEN 'val' ELSE 'train' END AS part FROM t UNION ALL SELECT doc_id, CAST(fold AS INTEGER), 'test' FROM x WHERE own = fold""")
def nested_folds(spark: SparkSession, sf: str) -> DataFrame:
    return classify.nested_folds(table(spark, sf, "labels"), "doc_id", "quality").select("doc_id", "fold", "part")


@query("""WITH runs AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS epoch, unnest(embedding)::DOUBLE AS score FROM runs),
b AS (SELECT *, max(score) OVER (PARTITION BY vec_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
l AS (SELECT *, max(CASE WHEN before IS NULL OR score > before THEN epoch END) OVER (PARTITION BY vec_id ORDER BY epoch) AS best_epoch FROM b),
ends AS (SELECT vec_id, coalesce(min(epoch) FILTER (epoch - best_epoch >= 2), max(epoch)) AS epochs FROM l GROUP BY vec_id)
SELECT l.vec_id, CAST(l.best_epoch AS INTEGER) AS best_epoch, round(s.score, 6) AS best, CAST(epochs AS INTEGER) AS epochs FROM ends JOIN l ON l.vec_id = ends.vec_id AND l.epoch = ends.epochs JOIN e s ON s.vec_id = l.vec_id AND s.epoch = l.best_epoch""")
def early_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector as the scores of a run by epoch."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    runs = table(spark, sf, "embeddings").filter((F.size("embedding") > 0) & usable)
    stop = training.early_stop(F.col("embedding"))
    return runs.select("vec_id", stop["best_epoch"].alias("best_epoch"), F.round(stop["best"], 6).alias("best"), stop["epochs"].alias("epochs"))


@query()
def baseline_report(spark: SparkSession, sf: str) -> DataFrame:
    """Both baselines on one split of the labelled documents: accuracy and macro-F1 on its test part."""
    rows = memory.embed(labelled_texts(spark, sf), F.col("text"))
    done = classify.run_baselines(rows, "label", classify.baseline_fits("label"))
    return spark.createDataFrame([(name, r["accuracy"], r["macro_f1"]) for name, r in done.items()], "model string, accuracy double, macro_f1 double")


@query("SELECT lang, source, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang, source")
def row_shares(spark: SparkSession, sf: str) -> DataFrame:
    return classify.shares(table(spark, sf, "documents"), ["lang", "source"]).withColumn("percent", F.round("percent", 6))


def labelled_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return classify.stratified_split(rows.select("doc_id", F.col("quality").cast("string").alias("label"), "text"), "doc_id", "label")


@query()
def tfidf_logreg(spark: SparkSession, sf: str) -> DataFrame:
    rows = labelled_texts(spark, sf)
    model = classify.tfidf_logistic(rows.filter("split = 'train'"), "label")
    done = classify.predict(model, rows.filter("split = 'test'").select("doc_id", "label", "text"))
    return done.select("doc_id", F.col("label").alias("y_true"), "y_pred", classify.argmax(F.col("probabilities")).alias("likeliest"))


@query()
def cv_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled text's prediction by the network of its test fold; five folds are fitted in one set of passes."""
    rows = cut(table(spark, sf, "labels").dropDuplicates(["doc_id"]).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.col("quality").cast("string").alias("label"), "text"))
    return neural.cross_validate(rows, "doc_id", "label", ["0", "1"])[0]


@query()
def fine_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and macro-F1 on the validation split by epoch, of a network trained on the labelled texts."""
    done = training.fine_tune(neural.Network("label", ["0", "1"]), labelled_texts(spark, sf), "label")
    return spark.createDataFrame([(h["epoch"], h["loss"], h["val_macro_f1"], h["epoch"] == done["best_epoch"], done["macro_f1"]) for h in done["history"]], "epoch int, loss double, val_macro_f1 double, best boolean, test_macro_f1 double")


@query()
def embedding_logreg(spark: SparkSession, sf: str) -> DataFrame:
    rows = classify.stratified_split(table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding"), "vec_id", "label")
    model = classify.embedding_logistic(rows.filter("split = 'train'"), "label")
    return classify.predict(model, rows.filter("split = 'test'"), "embedding").select("vec_id", F.col("label").alias("y_true"), "y_pred")


# -- memories and prompts


CARD = [memory.Card("assistant", "The Assistant", signature=r"\bthe that\b"), memory.Card("user", "The User", signature=r"\bla de\b")]


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, CASE role WHEN 'assistant' THEN 0 ELSE 1 END AS card FROM conversations),
rows_ AS (SELECT role AS character, coalesce(prev, '') AS context, text AS line, 'transcript' AS source, 0 AS s, card, conv_id * 1000 + turn AS t FROM c WHERE role IN ('assistant', 'user') AND {WORDS('text')} >= 4
UNION ALL SELECT k.name, coalesce(prev, ''), text, 'subtitle-signature', 1, k.card, conv_id * 1000 + turn FROM c, (VALUES ('assistant', '(?i)\\bthe that\\b', 0), ('user', '(?i)\\bla de\\b', 1)) k(name, pattern, card) WHERE regexp_matches(text, k.pattern))
SELECT character, context, line, source FROM (SELECT *, row_number() OVER (PARTITION BY character, line ORDER BY s, card, t) AS n FROM rows_) WHERE n = 1""")
def voice_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf)
    spoken = dialogue.with_previous(rows, ["episode"], "line_idx", {"text": "prev_line"}).select((F.col("episode") * 1000 + F.col("line_idx")).alias("turn"), F.col("role").alias("speaker"), F.col("text").alias("line"), "prev_line")
    return memory.voice(rows.select("episode", "line_idx", "text"), spoken, CARD)


@query(f"SELECT character, source, count(*) AS n FROM ({ORACLES['voice_table']}) GROUP BY character, source")
def voice_counts(spark: SparkSession, sf: str) -> DataFrame:
    return voice_table(spark, sf).groupBy("character", "source").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, n AS (SELECT episode, max(line_idx) + 1 AS n FROM lines GROUP BY episode), w AS (SELECT episode, unnest(range(0, greatest(n - 8, 0) + 1, 4)) AS first FROM n)
SELECT w.episode, {ARC('w.episode')} AS arc, w.first, string_agg(l.text, ' ' ORDER BY l.line_idx) AS text FROM w JOIN lines l ON l.episode = w.episode AND l.line_idx BETWEEN w.first AND w.first + 7 GROUP BY ALL""")
def scene_windows(spark: SparkSession, sf: str) -> DataFrame:
    found = memory.scenes(dialogue.with_arc(lines(spark, sf), ARCS))
    return found.withColumn("first", F.col("first").cast("long"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 3),
s AS (SELECT query_id, vec_id, list_dot_product(e, q) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(e, q) DESC, vec_id) AS place FROM v, q)
SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, round(s, 6) AS similarity FROM s WHERE place <= 4""")
def recall_exchanges(spark: SparkSession, sf: str) -> DataFrame:
    remembered = table(spark, sf, "embeddings").select(F.col("vec_id").alias("line"), F.col("label").cast("string").alias("character"), "embedding")
    found = memory.recall_exchanges(remembered, "3", questions(spark, sf), search=memory.nearest_of_many)
    return found.select("query_id", "place", F.col("line").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 20 = 0), v AS (SELECT vec_id, embedding::DOUBLE[] AS e, text FROM embeddings JOIN documents ON doc_id = vec_id),
s AS (SELECT query_id, vec_id, list_dot_product(e, q) + CASE WHEN contains(text, 'Ther') THEN 0.08 ELSE 0 END AS s FROM v, q), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS place, vec_id, round(s, 6) AS similarity FROM r WHERE place <= 3""")
def recall_scenes(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("episode"), "embedding")
    naming = table(spark, sf, "documents").select(F.col("doc_id").alias("episode"), memory.named("Ther An").alias("named"))  # no text moves
    found = memory.nearest_of_many(vectors.join(naming, "episode"), questions(spark, sf), 3, ["episode"], F.col("named"))
    return found.select("query_id", "place", F.col("episode").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(\p{L}+)', 1) AS w FROM documents), p AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT w[i] AS a, w[i + d] AS b FROM w, range(1, 5) t(d), unnest(range(1, len(w) - d + 1)) u(i)) GROUP BY ALL),
c AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p) GROUP BY a, b), t AS (SELECT a, sum(n) AS s FROM c GROUP BY a), x AS (SELECT c.a, c.b, c.n, ln(c.n * (SELECT sum(s) FROM t) / t.s / u.s) AS x FROM c JOIN t ON t.a = c.a JOIN t u ON u.a = c.b WHERE t.s >= 5 AND u.s >= 5)
SELECT a, b, round(x, 6) AS information FROM x WHERE x > 0""")
def word_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Positive mutual information of words within four words of each other."""
    found = vectors.pair_information(spread(table(spark, sf, "documents").select("text")))
    return found.select("a", "b", F.round("x", 6).alias("information"))


@query()
def document_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all documents from words of all documents."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return vectors.document_vectors(docs, cut(vectors.word_vectors(docs).words))


CENTRES = """means AS (SELECT label, i, avg(embedding[i + 1]::DOUBLE) AS x FROM embeddings, range(64) r(i) GROUP BY label, i), lengths AS (SELECT label, sqrt(sum(x * x)) AS l FROM means GROUP BY label)"""


@query(f"WITH {CENTRES} SELECT m.label, m.i AS i, round(x / l, 6) AS x FROM means m JOIN lengths USING (label)")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    return memory.centroids(table(spark, sf, "embeddings"), "label").select("label", F.posexplode("centroid").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


def arm_scores(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("reply"))
    arm = F.when(F.col("vec_id") % 2 == 0, "base").otherwise("lora")
    replies = vectors.join(docs, "vec_id").select(arm.alias("arm"), F.col("vec_id").alias("prompt_id"), "reply", "embedding", F.reverse("embedding").alias("prompt_embedding"))
    return memory.reply_scores(replies, memory.centroids(vectors, "label"), "label", "3", r"\bther\b")


ARMS = f"""{CENTRES}, c AS (SELECT m.label, list(x / l ORDER BY m.i) AS c FROM means m JOIN lengths USING (label) GROUP BY m.label),
r AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'base' ELSE 'lora' END AS arm, vec_id, embedding::DOUBLE[] AS e, text FROM embeddings JOIN documents ON doc_id = vec_id),
one AS (SELECT arm, vec_id, max(list_dot_product(e, c)) FILTER (label = 3) AS own, avg(list_dot_product(e, c)) FILTER (label <> 3) AS rest, max(list_dot_product(e, list_reverse(e))) AS relevance, any_value(text) AS text FROM r, c GROUP BY arm, vec_id),
scores AS (SELECT arm, avg(own) AS voice_similarity, avg(own - rest) AS distinctiveness, avg(relevance) AS relevance, avg(CASE WHEN regexp_matches(text, '(?i)\\bther\\b') THEN 1.0 ELSE 0.0 END) AS catchphrase_rate, avg({WORDS('text')}) AS words FROM one GROUP BY arm)"""


@query(f"WITH {ARMS} SELECT arm, {', '.join(f'round({c}, 5) AS {c}' for c in ('voice_similarity', 'distinctiveness', 'relevance', 'catchphrase_rate', 'words'))} FROM scores")
def distinctiveness(spark: SparkSession, sf: str) -> DataFrame:
    return arm_scores(spark, sf).select("arm", *[F.round(c, 5).alias(c) for c in ("voice_similarity", "distinctiveness", "relevance", "catchphrase_rate", "words")])


@query(f"WITH {ARMS} SELECT b.distinctiveness > a.distinctiveness AS more_distinctive, b.relevance >= 0.9 * a.relevance AS relevance_kept, b.words >= 0.5 * a.words AS substance_kept, b.catchphrase_rate <= 0.75 AS not_parroting, (b.distinctiveness > a.distinctiveness AND b.relevance >= 0.9 * a.relevance AND b.words >= 0.5 * a.words AND b.catchphrase_rate <= 0.75) AS recommend FROM scores a, scores b WHERE a.arm = 'base' AND b.arm = 'lora'")
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return memory.verdict(arm_scores(spark, sf))


@query("""WITH h AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS h, max_by(text, turn) AS message FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, message, [x FOR x IN h IF x.role IN ('user', 'assistant')] AS talk, h FROM h)
SELECT conv_id, len(talk[greatest(len(talk) - 11, 1):]) + 2 AS n_messages, array_to_string(list_concat([x.content FOR x IN h[greatest(len(h) - 1, 1):] IF x.role = 'user'], [message]), ' ') AS query FROM t""")
def prompt_messages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.max_by("text", "turn").alias("message"))
    history = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    none = F.array().cast("array<struct<context:string,line:string>>")
    made = memory.prompt(memory.system_text(CARD[0], F.array(), F.array()), none, history, F.col("message"))
    return rows.select("conv_id", F.size(made).cast("long").alias("n_messages"), memory.query_text(history, F.col("message")).alias("query"))


def letter_counts(texts: pd.Series) -> np.ndarray:
    """How often each small letter occurs: vectors whose products are whole numbers, in any order of sums."""
    found = texts.fillna("")
    return np.stack([found.str.count(chr(97 + k)).to_numpy(float) for k in range(26)], axis=1)


COUNTED = lambda c: f"[CAST(length({c}) - length(replace({c}, chr(97 + k::INT), '')) AS DOUBLE) FOR k IN range(26)]"


def cited(title: str, lines: str) -> str:
    return f"CASE WHEN len({lines}) > 0 THEN '{title}' || chr(10) || '- ' || array_to_string({lines}, chr(10) || '- ') END"


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
v AS (SELECT context, line, {COUNTED("context || ' ' || line")} AS e FROM (SELECT coalesce(prev, '') AS context, text AS line, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n FROM c WHERE role = 'assistant' AND {WORDS('text')} >= 4) WHERE n = 1),
n AS (SELECT conv_id AS episode, count(*) AS n FROM conversations GROUP BY conv_id), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS at FROM conversations),
w AS (SELECT episode, unnest(range(0, greatest(n - 8, 0) + 1, 4)) AS first FROM n),
s AS (SELECT *, {COUNTED('text')} AS e FROM (SELECT episode, {ARC('episode')} AS arc, first, string_agg(p.text, ' ' ORDER BY p.at) AS text FROM w JOIN placed p ON p.conv_id = episode AND p.at BETWEEN first AND first + 7 GROUP BY ALL)),
m AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
q AS (SELECT m.conv_id AS query_id, any_value(u.text) AS message, coalesce(list({{'role': h.role, 'content': h.text}} ORDER BY h.turn) FILTER (h.turn IS NOT NULL), []) AS history FROM m JOIN conversations u ON u.conv_id = m.conv_id AND u.turn = m.turn LEFT JOIN conversations h ON h.conv_id = m.conv_id AND h.turn < m.turn GROUP BY m.conv_id),
a AS (SELECT *, array_to_string(list_concat([x.content FOR x IN history[greatest(len(history) - 1, 1):] IF x.role = 'user'], [message]), ' ') AS asked, [x FOR x IN history IF x.role IN ('user', 'assistant')] AS talk FROM q),
b AS (SELECT *, {COUNTED('asked')} AS e, {COUNTED("'assistant: ' || asked")} AS f FROM a),
said AS (SELECT query_id, list(line ORDER BY place) AS lines, list(context ORDER BY place) AS contexts FROM (SELECT query_id, line, context, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(v.e, b.e) DESC, line, context) AS place FROM b, v) WHERE place <= 6 GROUP BY query_id),
seen AS (SELECT query_id, list('(Episode ' || episode || ', ' || arc || ') ' || text ORDER BY place) AS labels FROM (SELECT query_id, s.*, row_number() OVER (PARTITION BY query_id ORDER BY list_dot_product(s.e, b.f) + CASE WHEN contains(text, 'assistant') THEN 0.08 ELSE 0 END DESC, episode, first, arc, text) AS place FROM b, s) WHERE place <= 3 GROUP BY query_id),
parts AS (SELECT query_id, concat_ws(chr(10) || chr(10), 'Speak as The Assistant, in character throughout, and never as a program.', {cited('Lines of yours, for their tone:', 'lines[3:]')}, {cited('Scenes that may matter:', 'labels')}, 'Answer as assistant would, in a few short spoken sentences.') AS system, talk, message,
  list_concat(CASE WHEN contexts[1] <> '' THEN ['user: ' || contexts[1], 'assistant: ' || lines[1]] ELSE [] END, CASE WHEN contexts[2] <> '' THEN ['user: ' || contexts[2], 'assistant: ' || lines[2]] ELSE [] END) AS demos FROM b LEFT JOIN said USING (query_id) LEFT JOIN seen USING (query_id))
SELECT query_id, array_to_string(list_concat(['system: ' || system], demos, [x.role || ': ' || x.content FOR x IN talk[greatest(len(talk) - 11, 1):]], ['user: ' || message]), chr(10) || '----' || chr(10)) AS prompt FROM parts""")
def whole_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation's last question of a user, with all that is retrieved for it from the others' exchanges and scenes."""
    rows = turns(spark, sf)
    spoken = dialogue.with_previous(rows, ["episode"], "line_idx", {"text": "prev_line"}).select((F.col("episode") * 1000 + F.col("line_idx")).alias("turn"), F.col("role").alias("speaker"), F.col("text").alias("line"), "prev_line")
    card = memory.Card("assistant", "The Assistant")
    voices = memory.embed(memory.voice(rows.select("episode", "line_idx", "text"), spoken, [card]), F.concat_ws(" ", "context", "line"), letter_counts)
    scene_rows = memory.embed(memory.scenes(dialogue.with_arc(rows, ARCS)), F.col("text"), letter_counts)
    whole_talk = F.sort_array(F.collect_list(F.struct("line_idx", "role", F.col("text").alias("content"))))
    asked = rows.groupBy(F.col("episode").alias("query_id")).agg(whole_talk.alias("all"), F.max(F.when(F.col("role") == "user", F.struct("line_idx", "text"))).alias("last")).filter("last is not null")
    earlier = F.transform(F.filter("all", lambda x: x["line_idx"] < F.col("last.line_idx")), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    asks = asked.select("query_id", earlier.alias("history"), F.col("last.text").alias("message"))
    made = memory.prompts(cut(asks), card, cut(voices), cut(scene_rows), embedder=letter_counts, search=memory.nearest_of_many)
    told = F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return made.select("query_id", F.array_join(told, "\n----\n").alias("prompt"))


@query(f"""WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
v AS (SELECT * FROM (SELECT coalesce(prev, '') AS context, text AS line, row_number() OVER (PARTITION BY text ORDER BY conv_id, turn) AS n FROM c WHERE role = 'assistant' AND {WORDS('text')} >= 4) WHERE n = 1)
SELECT context AS user_content, line AS completion FROM v WHERE length(context) > 0""")
def sft_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = turns(spark, sf)
    spoken = dialogue.with_previous(rows, ["episode"], "line_idx", {"text": "prev_line"}).select((F.col("episode") * 1000 + F.col("line_idx")).alias("turn"), F.col("role").alias("speaker"), F.col("text").alias("line"), "prev_line")
    voices = memory.voice(rows.select("episode", "line_idx", "text"), spoken, [memory.Card("assistant", "The Assistant")])
    return memory.training_records(voices, CARD[0]).select(F.col("prompt")[1]["content"].alias("user_content"), F.col("completion")[0]["content"].alias("completion"))


# -- pages, tables, streams


@query("SELECT min(page_id) AS page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages GROUP BY 2")
def page_dedup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"))
    return dialogue.keep_first(pages, ["host"], ["page_id"])


@query(f"SELECT doc_id, {SQUEEZE('nfc_normalize(text)')} AS text FROM documents")
def nfc_text(spark: SparkSession, sf: str) -> DataFrame:
    return wikitext.normalised(table(spark, sf, "documents").select("doc_id", "text"))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND length(text) >= 20")
def item_validation(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumns({"classification": F.array("lang"), "description": F.col("text")})
    return wikitext.validated(docs).join(table(spark, sf, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unfinished_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS episodes, (SELECT count(*) FROM conversations) AS lines, (SELECT count(*) FROM labels) AS articles, (SELECT count(DISTINCT role) FROM conversations) AS personas")
def overview(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, "documents").agg(F.countDistinct("doc_id").alias("episodes")), table(spark, sf, "conversations").agg(F.count("*").alias("lines")), table(spark, sf, "labels").agg(F.count("*").alias("articles")), table(spark, sf, "conversations").agg(F.countDistinct("role").alias("personas"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_counts(spark: SparkSession, sf: str) -> DataFrame:
    from weftline.streaming import events

    return events.window_counts(table(spark, sf, "events"), "ts", ["event_type"]).select("event_type", "start", "n")

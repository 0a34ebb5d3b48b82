"""Queries of readers, names and scene memories, with SQL that gives the same rows.

Staged files are made of the standard tables, written where all executors can read them, and read by the
sources; the SQL computes the same rows from the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as X
from weftline.operators import dialogue, memory, mentions, themes
from weftline.plans.queries import ARC, ARCS, LABELS, LINES, SQUEEZE, STRAIGHT, WORDS, lines, query, table
from weftline.session import scratch
from weftline.sources import files, wikitext

# -- names


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in row) + ")" for row in rows)


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


# surfaces s -> names: cut-off names by their beginning, others by aliases of ever shorter forms, then by their shape
RESOLVED = f"""known AS MATERIALIZED (SELECT lower(a) AS a, c FROM (VALUES {values(fixed.alias_rows())}) t(a, c)), stop AS (SELECT w FROM (VALUES {values([(w,) for w in fixed.STOPLIST])}) t(w)),
bare AS (SELECT surface, trim(surface, {quoted(" .,!?…" + chr(34) + chr(39))}) AS raw FROM s),
named AS (SELECT surface, regexp_matches(raw, '[-–—]$') AS cut, regexp_replace(rtrim(regexp_replace(raw, '[-–— ]+$', '')), {quoted(fixed.POSSESSIVE)}, '') AS name FROM bare),
plain AS (SELECT *, trim(regexp_replace(name, {quoted(fixed.HONORIFIC)}, '')) AS plain FROM named),
untitled AS (SELECT *, trim(regexp_replace(plain, {quoted(fixed.TITLE)}, '')) AS untitled FROM plain),
proper AS (SELECT *, CASE WHEN untitled = upper(untitled) AND untitled <> lower(untitled) THEN array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(untitled, ' ')], ' ') ELSE untitled END AS proper FROM untitled),
begun AS (SELECT surface, min(c) AS c FROM named JOIN known ON starts_with(a, lower(name)) WHERE cut AND length(name) >= 3 GROUP BY surface HAVING count(DISTINCT c) = 1)
SELECT p.surface, CASE WHEN p.cut THEN b.c ELSE coalesce(x.c, y.c, z.c, CASE WHEN length(proper) >= 4 AND regexp_matches(proper, {quoted(fixed.NAME_SHAPE)}) AND lower(proper) NOT IN (SELECT w FROM stop) THEN proper END) END AS character
FROM proper p LEFT JOIN begun b ON b.surface = p.surface LEFT JOIN known x ON x.a = lower(plain) LEFT JOIN known y ON y.a = lower(untitled) LEFT JOIN known z ON z.a = lower(string_split(untitled, ' ')[1])"""


SPOKEN = "SELECT episode, line_idx, unnest(regexp_extract_all(text, '\\b([A-Z][a-z]{3,}(?:[- ][A-Z]?[a-z]+)?)', 1)) AS surface FROM lines"


@query(f"WITH {LINES}, said AS ({SPOKEN}), s AS (SELECT DISTINCT surface FROM said), r AS (SELECT * FROM (WITH {RESOLVED})) SELECT episode, r.character, count(*) AS n FROM said JOIN r USING (surface) WHERE r.character IS NOT NULL GROUP BY episode, r.character")
def alias_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document names whom: capitalised words, with a second word where one follows, resolved once each."""
    said = mentions.capitalised(lines(spark, sf), r"\b([A-Z][a-z]{3,}(?:[- ][A-Z]?[a-z]+)?)").select("episode", "line_idx", "surface")
    names = mentions.resolve(said.select("surface").distinct(), spark).filter("character is not null").select("surface", "character")
    return said.join(names, "surface").groupBy("episode", "character").agg(F.count("*").alias("n"))


@query(f"WITH {LINES}, s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([A-Z][a-z]{{3,}})', 1)) AS surface FROM lines), {RESOLVED}")
def surface_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return mentions.resolve(mentions.capitalised(lines(spark, sf)).select("surface").distinct(), spark).select("surface", "character")


@query(f"""WITH {LINES}, w AS (SELECT unnest([x FOR x IN regexp_split_to_array(lower(text), '[^a-z]+') IF x <> '']) AS word FROM lines)
SELECT word, round(log10(count(*) * 1e9 / sum(count(*)) OVER ()), 6) AS zipf FROM w GROUP BY word""")
def word_zipf(spark: SparkSession, sf: str) -> DataFrame:
    words = lines(spark, sf).select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''")
    return mentions.frequencies(words).withColumn("zipf", F.round("zipf", 6))


# -- scores and scenes


@query("SELECT vec_id, round(1 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)), 6) AS score FROM embeddings")
def entailment_scores(spark: SparkSession, sf: str) -> DataFrame:
    logit = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(themes.entailment(logit(0), logit(1)), 6).alias("score"))


@query(f"SELECT doc_id, theme, 'This dialogue is about ' || theme || '.' AS hypothesis FROM documents, (VALUES {values([(x,) for x in LABELS])}) t(theme)")
def hypotheses(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id").crossJoin(F.broadcast(themes.label_table(spark, LABELS)))  # a short list of labels


@query(f"""WITH {LINES}, n AS (SELECT episode, max(line_idx) + 1 AS n FROM lines GROUP BY episode), w AS (SELECT episode, unnest(range(0, greatest(n - 8, 0) + 1, 4)) AS first FROM n),
scene AS (SELECT w.episode, w.first, string_agg(l.text, ' ' ORDER BY l.line_idx) AS text FROM w JOIN lines l ON l.episode = w.episode AND l.line_idx BETWEEN w.first AND w.first + 7 GROUP BY ALL),
codes AS (SELECT episode, first, [unicode(x) FOR x IN string_split(' ' || lower(text) || ' ', '')] AS c FROM scene),
grams AS (SELECT episode, first, unnest([(c[k] * 961 + c[k + 1] * 31 + c[k + 2]) % 64 FOR k IN range(1, len(c) - 1)]) AS i FROM codes),
counts AS (SELECT episode, first, i, count(*)::DOUBLE AS n FROM grams GROUP BY ALL)
SELECT episode, first, CAST(i AS BIGINT) AS i, round(n / sqrt(sum(n * n) OVER (PARTITION BY episode, first)), 6) AS x FROM counts""")
def embedded_scenes(spark: SparkSession, sf: str) -> DataFrame:
    rows = memory.embed(memory.scenes(dialogue.with_arc(lines(spark, sf), ARCS)), F.col("text"))
    parts = rows.select("episode", F.col("first").cast("long").alias("first"), F.posexplode("embedding").alias("i", "x")).filter("x > 0")
    return parts.select("episode", "first", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"SELECT doc_id AS episode, '(Episode ' || doc_id || ', ' || ({ARC('doc_id')}) || ') ' || text AS label FROM documents")
def scene_labels(spark: SparkSession, sf: str) -> DataFrame:
    docs = dialogue.with_arc(table(spark, sf, "documents").select(F.col("doc_id").alias("episode"), "text"), ARCS)
    return docs.select("episode", memory.scene_label().alias("label"))


@query("SELECT conv_id, turn, ltrim(text) AS reply, text || ' ' || role AS content FROM conversations")
def replies(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.to_json(F.array(F.struct("text"), F.struct(F.col("role").alias("text"))))
    spoken = X.strip_speaker(F.concat(F.lit("  assistant: "), F.col("text")), ["user", "assistant"])
    return table(spark, sf, "conversations").select("conv_id", "turn", spoken.alias("reply"), X.message_text(parts).alias("content"))


# -- readers

PLAIN = "regexp_replace(replace(replace(replace(regexp_replace(replace(text, chr(10), ' '), '\\{[^}]*\\}', '', 'g'), '\\N', ' '), '\\n', ' '), '\\h', ' '), '<[^>]+>', '', 'g')"


@query(f"""WITH said AS (SELECT conv_id, turn * 2.5 AS start, turn * 2.5 + 1.25 AS "end", {SQUEEZE(STRAIGHT(PLAIN))} AS text FROM conversations)
SELECT CAST(conv_id AS INTEGER) AS episode, 1 AS season, CAST(start AS DOUBLE) AS start, CAST("end" AS DOUBLE) AS "end", text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY start) - 1 AS INTEGER) AS line_idx FROM said WHERE text <> ''""")
def subtitle_events(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a subtitle file, in one format if its id is odd, in the other if not."""

    def clock(s: Column, form: str, unit: int) -> Column:
        return F.format_string(form, F.floor(s / 3600), F.floor(s / 60) % 60, F.floor(s) % 60, F.round(s * unit).cast("long") % unit)

    one = F.replace("text", F.lit("\n"), F.lit(" "))
    begin, end, odd = F.col("turn") * 2.5, F.col("turn") * 2.5 + 1.25, F.col("conv_id") % 2 == 1
    ass = F.concat(F.lit("Dialogue: 0,"), clock(begin, "%d:%02d:%02d.%02d", 100), F.lit(","), clock(end, "%d:%02d:%02d.%02d", 100), F.lit(",Default,,0,0,0,,"), one)
    srt = F.concat(F.col("turn").cast("string"), F.lit("\n"), clock(begin, "%02d:%02d:%02d,%03d", 1000), F.lit(" --> "), clock(end, "%02d:%02d:%02d,%03d", 1000), F.lit("\n"), one)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(odd, ass).otherwise(srt).alias("line"))
    body = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]).alias("body"))
    head = "[Script Info]\nTitle: staged\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    name = F.concat(F.lit("staged/Season 1 - "), F.col("conv_id").cast("string"), F.when(odd, ".ass").otherwise(".srt"))
    raw = F.when(odd, F.concat(F.lit(head), F.array_join("body", "\n"))).otherwise(F.array_join("body", "\n\n"))
    return files.events(body.select(name.alias("path"), raw.alias("raw")))


LINE = f"trim(regexp_replace({STRAIGHT(chr(10).join(['regexp_replace(text, ' + quoted(chr(92) + '([^)]*' + chr(92) + ')|' + chr(92) + '[[^' + chr(92) + ']]*' + chr(92) + ']') + ', ' + quoted(' ') + ', ' + quoted('g') + ')']))}, '{X.SPACE_RE2}+', ' ', 'g'), ' -')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {LINE} AS line FROM conversations), k AS (SELECT * FROM t WHERE {WORDS('line')} >= 1)
SELECT row_number() OVER w - 1 AS turn, role AS speaker, line, lag(role) OVER w AS prev_speaker, lag(line) OVER w AS prev_line FROM k WINDOW w AS (ORDER BY conv_id, k.turn)""")
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "transcript")
    rows = table(spark, sf, "conversations").orderBy("conv_id", "turn").select(F.col("role").alias("name"), F.col("text").alias("line"))
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.transcript(spark, path).withColumn("turn", F.col("turn").cast("long"))


@query(f"SELECT 'd' || doc_id AS name, lang AS label, {SQUEEZE('text')} AS description, 'd' || doc_id || '. ' || {SQUEEZE('text')} AS text FROM documents WHERE lang IN ('fr', 'de', 'es') AND length({SQUEEZE('text')}) > 20")
def article_rows(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "articles")
    flat = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("jutsu_name"), F.col("lang").alias("jutsu_type"), F.col("text").alias("jutsu_description"))
    flat.write.json(path)
    return files.articles(spark, f"{path}-absent", path, ["fr", "de", "es"]).select("name", "label", "description", "text")


@query("SELECT doc_id, source, n_chars FROM documents")
def stored_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "stored")
    files.materialise(spark, path, lambda: table(spark, sf, "documents").select("doc_id", "source", "n_chars"))
    return files.materialise(spark, path, lambda: spark.range(0))  # read, not built again


@query("""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'),
  '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM pages""")
def html_plain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", wikitext.html_plain(F.col("html")).alias("text"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A' ELSE 'B' END AS rank, 'k' || page_id % 7 || '|x' AS classification, url AS users, 'Of ' || url || ' & more.' AS description FROM pages""")
def wiki_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with a box, lists with marks, notes and repeats, and prose with a link, a template and a section that goes."""
    kind = F.concat(F.lit("k"), (F.col("page_id") % 7).cast("string"))
    rank = F.when(F.col("page_id") % 3 == 0, "A").otherwise("B")
    parts = ["{{Infobox/Jutsu\n|jutsu classification=[[", kind, "]], x, [[Page|x]]\n|jutsu rank='''", rank, "'''\n|users=", F.col("url"), "~film, ", F.col("url"), " (a note)\n}}\nOf [[Some page|", F.col("url"), "]]{{cite|a{{b}}}} &amp; more.<ref>no</ref>\n== Trivia ==\nnot this\n"]
    text = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    page = F.struct(F.col("page_id").alias("pageid"), F.col("url").alias("title"), F.array(F.struct(F.struct(F.struct(text.alias("content")).alias("main")).alias("slots"))).alias("revisions"))
    responses = table(spark, sf, "pages").select(F.to_json(F.struct(F.struct(F.array(page).alias("pages")).alias("query"))).alias("value"))
    found = wikitext.parse_pages(files.wiki_pages(responses))
    return found.select("page_id", "rank", F.array_join("classification", "|").alias("classification"), F.array_join("users", "|").alias("users"), "description")


@query("""WITH m AS (SELECT page_id // 500 AS response, url, row_number() OVER (PARTITION BY page_id // 500 ORDER BY url) - 1 AS place FROM pages)
SELECT response, place // 50 AS request, string_agg(url, '|' ORDER BY place) AS titles FROM m GROUP BY response, request""")
def wiki_listing_requests(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.struct(F.sort_array(F.collect_list(F.struct(F.col("url").alias("title")))).alias("categorymembers"))
    responses = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 500).alias("response")).agg(F.to_json(F.struct(listed.alias("query"))).alias("value"))  # a response lists 500 titles
    return files.wiki_listing(responses, keys=["response"])


@query("""WITH p AS (SELECT page_id // 40 AS response, url FROM pages), n AS (SELECT response, count(*) AS n, row_number() OVER (ORDER BY response DESC) AS back FROM p GROUP BY response),
b AS (SELECT *, greatest(130 - coalesce(sum(n) OVER (ORDER BY response ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS room FROM n),
r AS (SELECT response, url, row_number() OVER (PARTITION BY response ORDER BY url) AS place FROM p)
SELECT b.response, coalesce(string_agg(url, '|' ORDER BY place) FILTER (place <= room), '') AS titles, CASE WHEN any_value(room) > any_value(n) AND any_value(back) > 1 THEN 'c' || (b.response + 1) END AS cursor FROM b JOIN r ON r.response = b.response GROUP BY b.response""")
def wiki_listing_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Listings of 40 titles, each with a cursor to the next, read up to 130 titles."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("url").alias("title")))).alias("categorymembers")
    lists = table(spark, sf, "pages").groupBy(F.floor(F.col("page_id") / 40).alias("response")).agg(listed)
    last = lists.agg(F.max("response").alias("last"))
    token = F.when(F.col("response") < F.col("last"), F.struct(F.concat(F.lit("c"), F.col("response") + 1).alias("cmcontinue")))
    value = F.to_json(F.struct(F.struct("categorymembers").alias("query"), token.alias("continue")))
    responses = lists.crossJoin(F.broadcast(last)).select("response", value.alias("value"))  # one row
    return files.wiki_chain(responses, "response", 130).select("response", F.array_join("titles", "|").alias("titles"), "cursor")

"""Retrieval memories, prompts, training records and the comparison of two sets of replies."""

from __future__ import annotations

import collections
import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.operators.dialogue import keep_first, with_previous
from weftline.operators.ordered import fold, in_order
from weftline.session import cut

#: Lines of a scene, and lines between the beginnings of two scenes.
SCENE, STRIDE = 8, 4


@dataclasses.dataclass(frozen=True)
class Card:
    """The stable part of a persona; ``signature`` is a pattern that marks its lines."""

    name: str
    full_name: str
    identity: str = ""
    personality: str = ""
    speech: str = ""
    relationships: str = ""
    signature: str | None = None
    greeting: str = ""
    examples: tuple[str, ...] = ()


# Names and signatures of the personas. Their prose is configuration: see ``read_cards``.
CARDS = [
    Card("Naruto", "Naruto Uzumaki", signature=r"\bbelieve it\b"),
    Card("Sasuke", "Sasuke Uchiha"),
    Card("Sakura", "Sakura Haruno"),
    Card("Kakashi", "Kakashi Hatake"),
]


def read_cards(path: str) -> list[Card]:
    """Cards from a JSON list of objects with the fields of ``Card``."""
    import json

    with open(path, encoding="utf-8") as file:
        return [Card(**{k: tuple(v) if isinstance(v, list) else v for k, v in one.items()}) for one in json.load(file)]


def card_table(spark: SparkSession, cards: list[Card] = CARDS) -> DataFrame:
    schema = "name string, full_name string, identity string, personality string, speech string, relationships string, signature string, greeting string, examples array<string>"
    return spark.createDataFrame([Row(**{**dataclasses.asdict(c), "examples": list(c.examples)}) for c in cards], schema)


def voice(lines: DataFrame, spoken: DataFrame | None, cards: list[Card], min_words: int = 4) -> DataFrame:
    """``(character, context, line, source)``: what a character said, and to what.

    Attributed lines ``spoken(turn, speaker, line, prev_line)`` come first, in order of cards and turns, then
    lines of ``lines(episode, line_idx, text)`` with a card's signature. Of a character's equal lines the first stays.
    """
    spark = lines.sparkSession
    order = spark.createDataFrame([(c.name, i) for i, c in enumerate(cards)], "character string, card int")
    parts = []
    if spoken is not None:
        mine = spoken.filter(X.word_count(F.col("line")) >= min_words).join(F.broadcast(order), F.col("speaker") == F.col("character"))
        parts.append(mine.select("character", F.coalesce("prev_line", F.lit("")).alias("context"), "line", F.lit("transcript").alias("source"), F.struct(F.lit(0).alias("s"), "card", F.lit(0).cast("long").alias("e"), F.col("turn").cast("long").alias("t")).alias("at")))
    before = with_previous(lines, ["episode"], "line_idx", {"text": "context"}, "")
    for i, card in enumerate(cards):
        if card.signature:
            said = before.filter(F.col("text").rlike(f"(?iu){card.signature}"))
            parts.append(said.select(F.lit(card.name).alias("character"), "context", F.col("text").alias("line"), F.lit("subtitle-signature").alias("source"), F.struct(F.lit(1).alias("s"), F.lit(i).alias("card"), F.col("episode").cast("long").alias("e"), F.col("line_idx").cast("long").alias("t")).alias("at")))
    if not parts:
        return spark.createDataFrame([], "character string, context string, line string, source string")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return keep_first(rows, ["character", "line"], ["at"]).drop("at")


class _Windows:
    """The last lines of a group, and how many there were."""

    def __init__(self, size: int, stride: int) -> None:
        self.lines, self.size, self.stride, self.n = collections.deque(maxlen=size), size, stride, 0

    def _text(self) -> str:
        return " ".join(line for line in self.lines if line is not None)

    def take(self, at: object, text: str | None) -> Iterator[tuple]:
        self.lines.append(text)
        self.n += 1
        first = self.n - self.size
        if first >= 0 and first % self.stride == 0:
            yield first, self._text()

    def end(self) -> Iterator[tuple]:
        if self.n < self.size:
            yield 0, self._text()


def scenes(lines: DataFrame, keys: list[str] = ["episode", "arc"], order: str = "line_idx", size: int = SCENE, stride: int = STRIDE) -> DataFrame:  # noqa: B006
    """``(*keys, first, text)``: overlapping windows of lines, at 0, stride, ... up to the last full one.

    A shorter group is one window; up to stride - 1 lines after the last full window are in none. Lines pass once, in
    order, and only a window of them is held.
    """
    return fold(lines.select(*keys, order, "text"), keys, [order], lambda: _Windows(size, stride), "first int, text string")


# -- embeddings

Embedder = Callable[[pd.Series], np.ndarray]


def hashed_grams(texts: pd.Series, dim: int = 64) -> np.ndarray:
    """The stand-in for a sentence encoder: counts of letter trigrams by a polynomial of their code points, at length 1."""
    padded = (" " + texts.fillna("").str.lower() + " ").tolist()
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    row = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    inside = row[:-2] == row[2:]
    grams = ((codes[:-2] * 961 + codes[1:-1] * 31 + codes[2:]) % dim)[inside]
    out = np.bincount(row[:-2][inside] * dim + grams, minlength=len(padded) * dim).reshape(-1, dim).astype(float)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


#: Characters of texts that an embedder gets at a time (a longer text goes alone), and texts at most.
LETTERS, TEXTS = 1 << 18, 1024


def _pieces(batch: pd.Series) -> Iterator[pd.Series]:
    """A batch of texts in pieces of bounded length, in order."""
    begin, letters = 0, 0
    for k, n in enumerate(batch.str.len().fillna(0).tolist()):
        if k > begin and (letters + n > LETTERS or k - begin == TEXTS):
            yield batch.iloc[begin:k]
            begin, letters = k, 0
        letters += n
    yield batch.iloc[begin:]


def embed(rows: DataFrame, text: Column, embedder: Embedder = hashed_grams) -> DataFrame:
    """Rows with ``embedding``, by Arrow batches; a model is loaded by the function that the worker calls.

    An embedder gets pieces of a batch, so that its own tables follow their length and not the batch's.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([x for piece in _pieces(batch) for x in np.asarray(embedder(piece), dtype=float)], index=batch.index)

    return rows.withColumn("embedding", encode(text))


def nearest(memory: DataFrame, queries: DataFrame, k: int, keys: list[str], boost: Column | None = None) -> DataFrame:
    """The k rows of ``memory(id, embedding)`` nearest to each of ``queries(query_id, query)``, all compared.

    Queries are the questions of one call and broadcast; each task keeps its own best k of a query before they
    are shuffled, so what moves is k rows for each task and query.
    """
    joined = memory.crossJoin(F.broadcast(queries))
    similarity = X.dot(F.col("embedding"), F.col("query"))
    scored = joined.withColumn("similarity", similarity + boost if boost is not None else similarity).drop("embedding", "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *keys)
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


#: Rows and queries of one block at most, and blocks that queries are dealt to at least.
ROWS_AT_ONCE, QUERIES_AT_ONCE, QUERY_BLOCKS = 65_536, 16_384, 8


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def nearest_of_many(memory: DataFrame, queries: DataFrame, k: int, keys: list[str], boost: Column | None = None) -> DataFrame:
    """``(query_id, place, *keys, similarity)``: what ``nearest`` finds, for any number of queries.

    Blocks of queries meet blocks of rows, and only the best k of a block move on. Products are summed in the
    order of ``X.dot``, so ties and their order are the same. Rows and queries without a vector are left out. Where
    keys are texts, places in their order stand for them until the nearest are found, so no text is copied to a block.
    """
    if any(memory.schema[c].dataType.simpleString() == "string" for c in keys):
        own = memory.filter("embedding is not null").select(*keys, "embedding", (F.lit(0.0) if boost is None else boost).cast("double").alias("boost"))
        placed = cut(in_order(own, keys, lambda window: {}, number="__number"))
        found = nearest_of_many(placed.select("__number", "embedding", "boost"), queries, k, ["__number"], F.col("boost"))
        return found.join(placed.select("__number", *keys), "__number").select("query_id", *keys, "similarity", "place")
    rows = memory.filter("embedding is not null").select(*keys, "embedding", (F.lit(0.0) if boost is None else boost).cast("double").alias("boost"))
    asked = queries.filter("query is not null").select("query_id", "query")
    row_blocks = max(1, -(-rows.count() // ROWS_AT_ONCE))
    query_blocks = max(QUERY_BLOCKS, -(-asked.count() // QUERIES_AT_ONCE))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("r", F.pmod(F.xxhash64(*keys), F.lit(row_blocks)).cast("int")).withColumn("q", every(query_blocks))
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("r", every(row_blocks))
    schema = ", ".join(["query_id " + asked.schema["query_id"].dataType.simpleString(), *(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys), "similarity double"])

    def of_block(some: pa.Table, questions: pa.Table) -> pa.Table:
        some = some.sort_by([(c, "ascending") for c in keys])  # of equal ones argmax takes the first
        n, m = some.num_rows, questions.num_rows
        best, at = np.full((m, k), -np.inf), np.full((m, k), -1)
        if n and m:
            vectors, extra, asks = _vectors(some["embedding"]), some["boost"].to_numpy(), _vectors(questions["query"])
            for i in range(0, n, 512):
                block = np.ascontiguousarray(vectors[i : i + 512].T)
                for j in range(0, m, 256):
                    asking = np.ascontiguousarray(asks[j : j + 256].T)
                    scores = np.zeros((asking.shape[1], block.shape[1]))
                    part = np.empty_like(scores)
                    for x, y in zip(asking, block):
                        scores += np.multiply(x[:, None], y[None, :], out=part)
                    scores = np.concatenate([best[j : j + 256], scores + extra[i : i + 512]], axis=1)
                    places = np.concatenate([at[j : j + 256], np.broadcast_to(np.arange(i, i + block.shape[1]), part.shape)], axis=1)
                    each = np.arange(len(scores))
                    for place in range(k):
                        first = scores.argmax(axis=1)
                        best[j : j + 256, place], at[j : j + 256, place] = scores[each, first], places[each, first]
                        # nothing is left of what was taken, not even a place
                        at[j : j + 256, place][np.isneginf(best[j : j + 256, place])] = -1
                        scores[each, first] = -np.inf
        who, place = np.nonzero(at >= 0)
        found = some.select(keys).take(pa.array(at[who, place]))
        return pa.table([questions["query_id"].take(pa.array(who)), *found.columns, pa.array(best[who, place])], names=["query_id", *keys, "similarity"])

    found = left.groupBy("r", "q").cogroup(right.groupBy("r", "q")).applyInArrow(of_block, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *keys)
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def recall_exchanges(remembered: DataFrame, character: str, queries: DataFrame, k: int = 4, search: Callable[..., DataFrame] = nearest) -> DataFrame:
    """Exchanges of one character, nearest first; ``search`` is ``nearest``, or ``nearest_of_many`` with its fewer columns."""
    return search(remembered.filter(F.col("character") == character), queries, k, ["line"])


def named(character: str, name_boost: float = 0.08) -> Column:
    """What a scene counts for more if it names the character (by its first word)."""
    return F.when(F.contains("text", F.lit(character.split()[0])), name_boost).otherwise(0.0)


def recall_scenes(remembered: DataFrame, character: str, queries: DataFrame, k: int = 3, name_boost: float = 0.08) -> DataFrame:
    """Scenes, nearest first; those that name the character (by its first word) count for more."""
    found = nearest(remembered, queries, k, ["episode", "first"], named(character, name_boost))
    return found.withColumn("label", scene_label())


def scene_label() -> Column:
    """How a prompt cites a scene."""
    return F.format_string("(Episode %d, %s) %s", "episode", "arc", "text")


# -- prompts


def system_text(card: Card, said: Column, seen: Column) -> Column:
    """The system message of a persona: who it is, how it talks, lines that it ``said`` and scenes that it has ``seen``.

    Parts that are empty are left out.
    """
    about = [f"{title}: {value}" for title, value in (("Identity", card.identity), ("Personality", card.personality), ("Speech", card.speech), ("People", card.relationships)) if value]
    listed = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}\n- "), F.array_join(lines, "\n- ")))
    first, last = f"Speak as {card.full_name}, in character throughout, and never as a program.", f"Answer as {card.name} would, in a few short spoken sentences. {card.speech}".rstrip()
    return F.array_join(F.array(*map(F.lit, [first, *about]), listed("Lines of yours, for their tone:", said), listed("Scenes that may matter:", seen), F.lit(last)), "\n\n")


def query_text(history: Column, message: Column) -> Column:
    """What is searched for: user turns among the last two messages, and the new message."""
    last = F.slice(history, F.greatest(F.size(history) - 1, F.lit(1)), F.lit(2))
    asked = F.transform(F.filter(last, lambda h: h["role"] == "user"), lambda h: X.message_text(h["content"]))
    return F.array_join(F.concat(asked, F.array(message)), " ")


def recent(history: Column, turns: int = 6) -> Column:
    """The last turns of user and assistant, two messages each."""
    talk = F.filter(history, lambda h: h["role"].isin("user", "assistant"))
    tidy = F.transform(talk, lambda h: F.struct(h["role"].alias("role"), X.message_text(h["content"]).alias("content")))
    return F.slice(tidy, F.greatest(F.size(tidy) - 2 * turns + 1, F.lit(1)), F.lit(2 * turns))


def demonstrations(exchanges: Column, demos: int = 2) -> Column:
    """The nearest exchanges as earlier turns; those without a context vanish and are not replaced."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    real = F.filter(F.slice(exchanges, 1, demos), lambda e: e["context"] != "")
    return F.flatten(F.transform(real, lambda e: F.array(message("user", e["context"]), message("assistant", e["line"]))))


def prompt(system: Column, exchanges: Column, history: Column, message: Column, demos: int = 2, turns: int = 6) -> Column:
    """System message, demonstrations, recent turns, and the message, as an array of (role, content)."""
    one = lambda role, c: F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))
    return F.concat(one("system", system), demonstrations(exchanges, demos), recent(history, turns), one("user", message))


def prompts(asks: DataFrame, card: Card, voices: DataFrame, scene_rows: DataFrame, examples: int = 4, demos: int = 2, scenes: int = 3, name_boost: float = 0.08, turns: int = 6, embedder: Embedder | None = None, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """``(query_id, messages, voice, scenes)`` of ``asks(query_id, history, message)``: whole prompts of one persona.

    The nearest exchanges of ``voices`` open the conversation, the next ones and the nearest scenes are cited in the
    system message. Many questions are asked at once where ``search`` is ``nearest_of_many``; at most ``examples``
    + ``demos`` lines and ``scenes`` labels come to a question.
    """
    embedder, search = embedder or hashed_grams, search or nearest
    asked = asks.withColumn("asked", query_text(F.col("history"), F.col("message")))
    vectors = lambda text: embed(asked.select("query_id", text.alias("asked")), F.col("asked"), embedder).select("query_id", F.col("embedding").alias("query"))
    in_place = lambda found, *of: found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("place", *of))).alias("found"))
    said = in_place(search(voices.filter(F.col("character") == card.name), vectors(F.col("asked")), examples + demos, ["line", "context"]), "line", "context")
    cited = search(scene_rows, vectors(F.concat(F.lit(f"{card.name}: "), "asked")), scenes, ["episode", "first", "arc", "text"], named(card.name, name_boost))
    seen = in_place(cited.withColumn("label", scene_label()), "label")
    rows = asked.join(said.withColumnRenamed("found", "said"), "query_id", "left").join(seen.withColumnRenamed("found", "seen"), "query_id", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    exchanges = F.coalesce("said", none(rows.schema["said"].dataType.elementType.simpleString()))
    labels = F.coalesce(F.transform("seen", lambda x: x["label"]), none("string"))
    lines = F.transform(exchanges, lambda x: x["line"])
    # what was replayed as conversation is not cited again
    system = system_text(card, F.filter(lines, lambda x, k: k >= demos), labels)
    return rows.select("query_id", prompt(system, exchanges, F.col("history"), F.col("message"), demos, turns).alias("messages"), lines.alias("voice"), labels.alias("scenes"))


def training_records(voices: DataFrame, card: Card, min_words: int = 3) -> DataFrame:
    """``(prompt, completion)`` of a character's exchanges with a context and enough words; an error if there is none."""
    rows = voices.filter((F.col("character") == card.name) & (F.length("context") > 0) & (X.word_count(F.col("line")) >= min_words))
    if rows.isEmpty():
        raise ValueError(f"no exchanges of {card.name}")
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(F.array(one("system", system_text(card, F.array(), F.array())), one("user", F.col("context"))).alias("prompt"), F.array(one("assistant", F.col("line"))).alias("completion"))


# -- comparing replies


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """``(by, centroid)``: mean of a group's vectors, at length 1. Means are of dimensions, so groups of any size combine early."""
    mean = vectors.select(by, F.posexplode(vector).alias("i", "x")).groupBy(by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"))
    return whole.select(by, X.unit(F.col("mean")).alias("centroid"))


def reply_scores(replies: DataFrame, centres: DataFrame, by: str, own: str, signature: str | None = None) -> DataFrame:
    """One row an arm: how replies ``(arm, prompt_id, reply, embedding, prompt_embedding)`` match a character.

    Similarity to its centroid, the same less the mean of the others', similarity to the prompt, share of replies
    with the signature, and mean words.
    """
    met = replies.crossJoin(F.broadcast(centres)).withColumn("s", X.dot(F.col("embedding"), F.col("centroid")))  # one centroid a character
    mine = F.max(F.when(F.col(by) == own, F.col("s")))
    rest = F.coalesce(F.avg(F.when(F.col(by) != own, F.col("s"))), F.lit(0.0))
    one = met.groupBy("arm", "prompt_id").agg(mine.alias("own"), rest.alias("rest"), F.first("reply").alias("reply"), F.max(X.dot(F.col("embedding"), F.col("prompt_embedding"))).alias("relevance"))
    catch = F.avg(F.col("reply").rlike(f"(?iu){signature}").cast("double")) if signature else F.lit(None).cast("double")
    return one.groupBy("arm").agg(F.avg("own").alias("voice_similarity"), F.avg(F.col("own") - F.col("rest")).alias("distinctiveness"), F.avg("relevance").alias("relevance"), catch.alias("catchphrase_rate"), F.avg(X.word_count(F.col("reply"))).alias("words"))


def verdict(scores: DataFrame, base: str = "base", new: str = "lora") -> DataFrame:
    """Whether the new arm sounds more like the character without being of less use: four checks, and all of them."""
    a, b = (scores.filter(F.col("arm") == arm).select(*[F.col(c).alias(f"{c}_{k}") for c in ("distinctiveness", "relevance", "words", "catchphrase_rate")]) for arm, k in ((base, "a"), (new, "b")))
    checks = {
        "more_distinctive": F.col("distinctiveness_b") > F.col("distinctiveness_a"),
        "relevance_kept": F.col("relevance_b") >= 0.9 * F.col("relevance_a"),
        "substance_kept": F.col("words_b") >= 0.5 * F.col("words_a"),
        "not_parroting": F.col("catchphrase_rate_b").isNull() | (F.col("catchphrase_rate_b") <= 0.75),
    }
    out = a.crossJoin(b).select(*[c.alias(name) for name, c in checks.items()])  # one row each
    every = F.col("more_distinctive") & F.col("relevance_kept") & F.col("substance_kept") & F.col("not_parroting")
    return out.withColumn("recommend", every)

import json
import os

import pytest
from pyspark.sql import functions as F

from weftline import config, fixed
from weftline.functions import text as X
from weftline.operators import dialogue
from weftline.sources import files, wikitext

ASS = """[Script Info]
Title: x

[V4+ Styles]
Format: Name, Fontname

[Events]
Format: Layer,Start,End,Style,Name,MarginL,MarginR,MarginV,Effect,Text
Comment: 0,0:00:01.00,0:00:02.00,Default,,0000,0000,0000,,never
Dialogue: 0,0:01:04.58,0:01:05.66,Default,,0000,0000,0000,,{\\i1}Hello!{\\i0}
Dialogue: 0,0:00:05.95,0:00:11.99,Default,,0000,0000,0000,,The old bell rang,\\Nand nobody came.
Dialogue: 0,0:00:12.00,0:00:13.00,Default,,0000,0000,0000,,{\\an8}
"""
SRT = "1\r\n00:00:17,094 --> 00:00:18,512\r\n<i>C’mon!</i>\r\n\r\n2\r\n00:00:20.000 --> 00:00:21.500\r\ntwo\r\nlines\r\n"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_cleaning(spark):
    assert one(spark, X.clean_text, "“Hi”\\N {\\b1}there　<i>you</i>’s ") == "\"Hi\" there you's"
    assert one(spark, X.clean_line, " (Sighs) Leave it. (Waves) Later!") == "Leave it. Later!"
    assert one(spark, X.lyric_norm, " La-La, don't 5 ") == "lala don't"
    assert [one(spark, X.word_count, v) for v in ("", "  ", "a", " a\tb  c", None)] == [0, 0, 1, 3, 0]
    assert one(spark, X.timecode, "1:02:03.50") == 3723.5
    assert one(spark, lambda c: X.strip_speaker(c, ["Ann", "Ann Lee"]), "  Ann: hi") == "hi"
    assert one(spark, lambda c: X.article_url("https://w", c), "A b/ç (c)") == "https://w/wiki/A_b/%C3%A7_%28c%29"
    assert one(spark, X.message_text, '[{"text": "a"}, {"text": "b"}]') == "a b" and one(spark, X.message_text, "plain") == "plain"


def test_labels_and_lists(spark):
    rows = spark.createDataFrame([(["Ninjutsu", "genjutsu x"], None), ([], "Taijutsu, Kenjutsu "), (["Kenjutsu"], "x"), (None, None)], "a array<string>, b string")
    classes = X.classes_of(F.col("a"), F.col("b"))
    assert [r[0] for r in rows.select(X.primary_label(classes, fixed.LABEL_PRIORITY)).collect()] == ["Genjutsu", "Taijutsu", None, None]
    assert one(spark, lambda c: X.split_list(c, True), "Mira Vell~film, Odo (a guest), , Mira Vell") == ["Mira Vell", "Odo"]


def test_subtitles(spark, tmp_path):
    (tmp_path / "Show Season 1 - 03.ass").write_text("﻿" + ASS, encoding="utf-8")
    (tmp_path / "Show season 2 - 14.SRT").write_bytes(SRT.encode() + b"\r\n3\r\n00:00:30,000 --> 00:00:31,000\r\nbad \xff byte\r\n")
    (tmp_path / "notes.txt").write_text("x")
    rows = [tuple(r) for r in files.subtitles(spark, str(tmp_path)).orderBy("episode", "line_idx").select("episode", "season", "line_idx", "start", "end", "text").collect()]
    assert rows == [(3, 1, 0, 5.95, 11.99, "The old bell rang, and nobody came."), (3, 1, 1, 64.58, 65.66, "Hello!"), (14, 2, 0, 17.094, 18.512, "C'mon!"), (14, 2, 1, 20.0, 21.5, "two lines"), (14, 2, 2, 30.0, 31.0, "bad � byte")]
    os.mkdir(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        files.subtitles(spark, str(tmp_path / "none"))


def test_transcript_and_articles(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,line\nAnn," (Waves) Hi, ""you""."\nBo,\nBo,(Nods)\nCy,Fine - \n')
    rows = [tuple(r) for r in files.transcript(spark, str(tmp_path / "t.csv")).orderBy("turn").collect()]
    assert rows == [(0, "Ann", 'Hi, "you".', None, None), (1, "Cy", "Fine", "Ann", 'Hi, "you".')]
    lines = [{"name": " A ", "classification": ["Ninjutsu"], "description": "some  text that is long enough"}, {"jutsu_name": "B", "jutsu_type": "Taijutsu", "jutsu_description": "x" * 20}, {"jutsu_name": "C", "jutsu_type": "Taijutsu, Genjutsu", "jutsu_description": "x" * 21}, {"name": " A ", "classification": ["Genjutsu"], "description": "a later one that is dropped"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    out = {r["name"]: (r["label"], r["text"]) for r in files.articles(spark, str(tmp_path / "missing"), str(tmp_path / "a.jsonl")).collect()}
    assert out == {" A ": ("Ninjutsu", "A. some text that is long enough"), "C": ("Genjutsu", "C. " + "x" * 21)}
    with pytest.raises(FileNotFoundError):
        files.articles(spark, str(tmp_path / "missing"))


def test_tables_are_built_once_and_scores_resume(spark, tmp_path):
    built = []
    make = lambda: (built.append(1), spark.range(3))[1]
    assert files.materialise(spark, f"{tmp_path}/t", make).count() == files.materialise(spark, f"{tmp_path}/t", make).count() == 3 and len(built) == 1
    files.materialise(spark, f"{tmp_path}/t", make, refresh=True)
    assert len(built) == 2
    for n in (3, 5):
        done = files.resume(spark, f"{tmp_path}/s", spark.range(n), "id", lambda rest: rest.withColumn("n", F.lit(n)))
    assert sorted((r["id"], r["n"]) for r in done.collect()) == [(0, 3), (1, 3), (2, 3), (3, 5), (4, 5)]
    with pytest.raises(ValueError):
        files.records(spark.range(20), limit=10)


def test_lyrics_and_arcs(spark):
    rows = [(e, s, s + 2.0, t, i) for e in range(1, 7) for i, (s, t) in enumerate([(10.0, "We are fighting dreamers!"), (600.0, "We are fighting dreamers!"), (20.0, "Naruto!"), (900.0, f"a line of {'abcdef'[e - 1] * 4}")])]
    lines = spark.createDataFrame(rows, "episode int, start double, end double, text string, line_idx int")
    flagged = {(r["episode"], r["line_idx"]): r["is_song"] for r in dialogue.flag_repeated(lines, 5, 150.0).collect()}
    assert all(flagged[e, 0] and not flagged[e, 1] and not flagged[e, 2] and not flagged[e, 3] for e in range(1, 7))
    kept = dialogue.dialogue(lines).filter("episode = 6").orderBy("line_idx").collect()
    assert [r["line_idx"] for r in kept] == [1, 2, 3] and kept[0]["arc"] == "Land of Waves"
    arcs = [r["arc"] for r in dialogue.with_arc(spark.range(1, 221).withColumnRenamed("id", "episode")).orderBy("episode").collect()]
    assert (arcs[0], arcs[61], arcs[219]) == ("Prologue", "Chūnin Exams", "Post-Recovery (filler)") and fixed.UNKNOWN_ARC not in arcs
    assert dialogue.with_arc(spark.range(1).withColumnRenamed("id", "episode")).first()["arc"] == fixed.UNKNOWN_ARC


WIKI = """{{Infobox/Jutsu
|jutsu classification=[[Ninjutsu]], [[Hiden|Secret]]
|jutsu type=Fire Release<ref>x</ref>
|jutsu rank=B
|users=[[Mira Vell]]~film, Odo (a guest)<!-- no -->, Mira Vell
}}
'''Name''' is a {{nihongo|thing|x{{y}}}}[[technique|skill]] of [[fire]].[[File:a.png|thumb|a [[b]]]]
== Use ==
It burns &amp; glows.[[fr:Nom]]
== Trivia ==
* not this
"""


def test_wikitext(spark):
    assert wikitext.prose(WIKI) == "Name is a skill of fire. It burns & glows." and wikitext.infobox("no box") is None
    body = json.dumps({"query": {"pages": [{"pageid": 4, "title": "T", "revisions": [{"slots": {"main": {"content": WIKI}}}]}, {"pageid": 5, "title": "U"}]}})
    pages = wikitext.parse_pages(files.wiki_pages(spark.createDataFrame([(body,)], "value string")))
    row = wikitext.validated(wikitext.normalised(pages)).first()
    assert row["classification"] == ["Ninjutsu", "Secret"] and row["nature"] == ["Fire Release"] and row["hand_signs"] == [] and row["rank"] == "B" and row["range"] is None
    assert row["page_id"] == 4 and row["users"] == ["Mira Vell", "Odo"] and row["description"].startswith("Name is")
    listing = json.dumps({"query": {"categorymembers": [{"title": f"t{i}"} for i in range(5)]}})
    assert sorted(r["titles"] for r in files.wiki_listing(spark.createDataFrame([(listing,)], "value string"), batch=3).collect()) == ["t0|t1|t2", "t3|t4"]


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("WEFTLINE__THEMES__CHUNK_MAX_TOKENS", "99")
    monkeypatch.setenv("WEFTLINE__THEMES__LABELS", "[a, b]")
    (tmp_path / "c.yaml").write_text("characters:\n  min_mentions: 3\npaths:\n  outputs_dir: o\n")
    config.settings.cache_clear()
    s = config.settings(str(tmp_path / "c.yaml"))
    assert s.themes.chunk_max_tokens == 99 and s.themes.labels == ("a", "b") and s.characters.min_mentions == 3 and s.out("x") == f"{tmp_path}/o/x"
    config.settings.cache_clear()

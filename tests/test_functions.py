import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opinara.functions import rules
from opinara.functions import text as T
from opinara.operators import collect as C
from opinara.operators import ingest as I
from opinara.operators import reviews as R
from opinara.operators import signals as S
from opinara.sources import files
from opinara.streaming import reviews as ST


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "day"), [("2024-3-4", dt.date(2024, 3, 4)), ("3/4/2024", dt.date(2024, 3, 4)), ("13/4/2024", dt.date(2024, 4, 13)), ("2024/5/6", dt.date(2024, 5, 6)), ("soon", None), (None, None)])
def test_parse_date(spark, raw, day):
    assert one(spark, raw, T.parse_date) == day


@pytest.mark.parametrize(("raw", "value"), [("4.5", 4.5), (" 5 ", 5.0), ("5.1", None), ("nan", None), ("x", None), ("", None)])
def test_parse_rating(spark, raw, value):
    assert one(spark, raw, T.parse_rating) == value


def test_stop_words_come_from_the_session_where_pyspark_has_no_jars(spark, monkeypatch, tmp_path):
    want = rules.stop_words("english", "german", "french", "spanish")
    monkeypatch.setattr(rules.pyspark, "__file__", str(tmp_path / "__init__.py"))
    assert rules.stop_words.__wrapped__("english", "german", "french", "spanish") == want and len(want) > 500


def test_text_functions(spark):
    assert one(spark, " <b>Hi</b>  there ", T.clean_text) == "Hi there"
    assert one(spark, None, T.clean_text) == ""
    assert one(spark, "a b? c", T.sentences) == ["a b?", "c"]
    assert one(spark, "HTTP://u@Ex.com:80/a/?q=1#z", T.canonical_url) == "http://ex.com:80/a"
    assert one(spark, "mail a.b@c.de or +1 (212) 555-1234", T.redact) == "mail [EMAIL] or [PHONE]"
    assert one(spark, "AAAAAAA", T.quality_flags) == ["extremely_short_text", "excessive_caps", "repeated_characters"]
    assert one(spark, "Привет всем", T.language_hint) == "non_english_or_unknown"
    assert one(spark, "éfoo", lambda c: T.has_term(c, "foo")) is False
    assert one(spark, "=1+1", files.safe_cell) == "'=1+1"


def test_ingest_counts(spark):
    raw = spark.createDataFrame([(2, "Good phone", "5", "2024-01-01"), (3, " ", "4", ""), (4, "good  PHONE", "4", ""), (5, "Bad", "10", "")], "row_no int, text string, rating string, date string")
    assert {r.status: r.n for r in I.outcomes(I.classify(raw)).collect()} == {"valid": 1, "empty_text": 1, "duplicate": 1, "bad_rating": 1}


def test_reconcile_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert {r.state for r in R.reconcile(new, new, ["k"], "v").collect()} == {"unchanged"}
    assert R.overlay(new, new, ["k"]).count() == 2


def test_adjacent_windows(spark):
    rows = [(dt.date(2024, 1, 14) - dt.timedelta(days=k),) for k in (13, 12, 11, 10, 1, 1, 1, 1, 1, 1, 1)] + [(None,)]
    got = S.windows(spark.createDataFrame(rows, "review_date date"), "2024-01-14").groupBy("win").count().collect()
    assert {r.win: r["count"] for r in got} == {"baseline": 4, "current": 7}


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿text,stars\n"one, ""two""",4\n')
    (tmp_path / "a.json").write_text(json.dumps([{"b": 1, "a": "x"}, {"c": None}]))
    df = files.map_columns(files.read_rows(spark, str(tmp_path / "a.csv"), "csv"), {"text": "text", "rating": "stars"})
    assert [tuple(r) for r in df.collect()] == [('one, "two"', "4", None, None)]
    assert files.read_rows(spark, str(tmp_path / "a.json"), "json").count() == 2
    with pytest.raises(ValueError):
        files.map_columns(df, {"rating": "rating"})


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 2, dt.datetime(2024, 1, 1) + dt.timedelta(days=k), "best" if k % 3 else "idiot") for k in range(20)]
    df = spark.createDataFrame(rows, "project_id int, ts timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    lex = {"best": 2.0, "idiot": -2.0}
    q = ST.windowed_trend(stream, lex).writeStream.format("memory").queryName("got").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("got").collect())) == sorted(map(tuple, ST.windowed_trend(df, lex).collect()))


def test_spans_and_rules(spark):
    text = "It is slow. I switched from Acme to Globex because it works! Why? é slow"
    got = one(spark, text, lambda c: T.spans(c, r"(?i)\bslow\b"))
    assert [(x.start, x.end, x.text) for x in got] == [(6, 10, "slow"), (68, 72, "slow")] and text[68:72] == "slow"
    assert [x.text for x in one(spark, text, T.sentence_spans)][-2:] == ["Why?", "é slow"]
    df = spark.createDataFrame([(1, 0, text), (2, 0, "Globex, moved to Acmes"), (3, 0, None)], "review_id int, project_id int, text string")
    rows = {(r.review_id, r.competitor): (r.switching, r.reason) for r in S.competitors(df, ["Acme", "Globex"]).collect()}
    assert rows == {(1, "Acme"): (False, None), (1, "Globex"): (True, "it works!"[:-1]), (2, "Globex"): (False, None)}


def test_urls_and_terms(spark):
    assert one(spark, "HTTPS://u@Ex.com:8443/a/b?x=1#y).", T.safe_url) == "https://ex.com:8443/a/b"
    assert one(spark, "ftp://ex.com", T.safe_url) is None
    assert one(spark, "https://www.amazon.in/x", T.source_label) == "Amazon"
    assert one(spark, "https://shop.example/Best-Phone_2/p?id=1", T.slug_name) == "Best Phone 2"
    assert one(spark, ["a", " A ", "b", ""], T.unique_terms, "x array<string>"[2:]) == ["a", "b"]
    assert one(spark, "rated 4.5 of 5", T.rating_in_text) == 4.5
    assert one(spark, "x" * 301, T.truncated) == "x" * 270 + "..."
    assert one(spark, "a\x00b", T.sanitized) == "ab"
    assert C.canonical_name("Acme Phone", "Phone X2") == "Acme Phone X2" and C.discovered("Acme Phone X2") == ("Acme", "X2")


def test_excel_and_key_order(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>text</t></si><si><t>good one</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>stars</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>4</v></c></row><row><c r="B3"><v>5</v></c></row></sheetData></worksheet>')
    got = files.read_rows(spark, str(tmp_path / "a.xlsx"), "excel")
    assert got.columns == ["text", "stars"] and [tuple(r) for r in got.collect()] == [("good one", "4"), (None, "5")]
    (tmp_path / "b.json").write_text('[{"z": 1, "a": 2}, {"m": 3}]')
    assert files.read_rows(spark, str(tmp_path / "b.json"), "json").columns == ["z", "a", "m"]
    (tmp_path / "up").mkdir()
    for name, text in (("1", "x"), ("2", "x"), ("3", "")):
        (tmp_path / "up" / name).write_text(text)
    uploads = spark.createDataFrame([(f"file:{tmp_path}/up/{k}",) for k in "123"], "path string")
    state = {r.path[-1]: r.status for r in files.file_registry(spark, str(tmp_path / "up"), uploads=uploads).collect()}
    assert state == {"1": "new", "2": "duplicate", "3": "empty"}


def test_vocabulary_and_writes(spark):
    assert R.overlaid({"price": ["price"]}, [("Price", ["Cost", "cost "]), ("new", [])]) == {"price": ["price", "cost"], "new": ["new"]}
    old, new = (spark.createDataFrame(x, "a int, b int") for x in ([(2, 1)], [(1, 2), (1, 3)]))
    assert [tuple(r) for r in R.insert_missing(old, new, "a", "b").collect()] == [(1, 3)]
    assert R.dimension(old, new, ["a"]).count() == 2
    flagged = R.flag(spark.createDataFrame([(1, False), (2, False)], "review_id int, is_spam boolean"), spark.createDataFrame([(2,)], "review_id int"), "is_spam")
    assert {r.review_id: r.is_spam for r in flagged.collect()} == {1: False, 2: True}
    with pytest.raises(ValueError):
        files.strict_json('{"a": 1, "a": 2}', {"a"})


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a int, b int")
    assert {r.component for r in S.components(chain, "a", "b").collect()} == {0}


def test_first_seen_stream_drops_repeats(spark, tmp_path):
    rows = [(0, dt.datetime(2024, 1, 1), t) for t in ("One text", "one  TEXT", "two")]
    df = spark.createDataFrame(rows, "project_id int, ts timestamp, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = ST.first_seen(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("first").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first").count() == 2

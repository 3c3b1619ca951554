import pytest
from pyspark.sql import functions as F

from linestream.functions.text import slug, trim_unicode
from linestream.operators.sections import split_sections, unique_slugs
from linestream.operators.text import assemble_original, assemble_translation, clean_lines, lexicon_translate
from linestream.sources.sinks import export_stamped, write_stamped
from linestream.sources.tables import lines_from_text, read_lines
from linestream.schema import LINES


def frame_lines(spark, texts, **extra):
    data = [("s", 1, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "session_id string, frame_seq long, line_no int, text string")


def test_every_unicode_space_is_trimmed(spark):
    spaces = " \u00a0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\t\n\x0b\f\r\x85"
    df = spark.createDataFrame([(spaces + "a b" + spaces,), (spaces,), ("\u200bz",)], "t string")
    got = [r[0] for r in df.select(trim_unicode(F.col("t"))).collect()]
    assert got == ["a b", "", "\u200bz"]
    assert df.select(F.trim("t").alias("t")).first()["t"] != "a b"


def test_clean_drops_what_becomes_empty(spark, rows):
    got = rows(clean_lines(frame_lines(spark, [" a ", "\u3000", "", "b"])), "line_no", "text")
    assert got == [(0, "a"), (3, "b")]


def test_lines_keep_order_and_blanks_and_join_back(spark):
    texts = ["a\n\nb", "", "one", "x\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    lines = lines_from_text(df, ["id"])
    assert lines.where("id = 0").orderBy("line_no").select("text").collect() == [("a",), ("",), ("b",)]
    back = {r["id"]: r["original"] for r in assemble_original(lines, ["id"]).collect()}
    assert back == {0: "a\n\nb", 2: "one", 3: "x\n"}


def test_assembly_policies(spark):
    df = spark.createDataFrame(
        [("s", 1, 2, "c", None), ("s", 1, 10, "d", "D"), ("s", 1, 1, "", None), ("s", 1, 0, "a", "A"), ("s", 2, 0, "q", None)],
        "session_id string, frame_seq long, line_no int, text string, translated string",
    )
    get = lambda p: {r["frame_seq"]: r["translation"] for r in assemble_translation(df, p).collect()}
    assert get("region") == {1: "A\nD"}
    assert get("live") == {1: "A\nc\nD", 2: "q"}


def test_lexicon_keeps_unknown_tokens_and_spaces(spark, rows):
    req = spark.createDataFrame([(1, "fr", "le  chat dort"), (2, "de", "le"), (3, "fr", "")], "id int, source string, text string")
    lex = spark.createDataFrame(
        [("fr", "en", "le", "the"), ("fr", "de", "dort", "schlaeft"), ("fr", "en", "dort", "sleeps")],
        "source string, target string, token string, out string",
    )
    assert rows(lexicon_translate(req, lex, ["id"])) == [(1, "the  chat sleeps"), (2, "le"), (3, "")]


def test_lexicon_too_large_to_broadcast(spark, rows, monkeypatch):
    from linestream import scale

    req = spark.range(200).select("id", F.lit("fr").alias("source"), F.concat(F.lit("le mot"), F.col("id")).alias("text"))
    lex = spark.createDataFrame([("fr", "en", "le", "the")], "source string, target string, token string, out string")
    want = rows(lexicon_translate(req, lex, ["id"]))
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 0)
    assert rows(lexicon_translate(req, lex, ["id"])) == want


def test_sections(spark):
    text = "intro\n## One (2024-02-03)  \na\n\n### not\n##two\n##  Two words \n  b \n## (2024-01-01)"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = split_sections(lines_from_text(df, ["doc_id"])).orderBy("section_no").collect()
    assert [(r["title"], r["date"], r["body"]) for r in got] == [
        ("One", "2024-02-03", "a\n\n### not\n##two"),
        ("Two words", "", "b"),
        ("(2024-01-01)", "", ""),
    ]


def test_sections_of_a_hot_document(spark, rows):
    text = "\n".join(f"## h{i // 5}" if i % 5 == 0 else f"line {i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, "## x\ny")], "doc_id long, text string")
    lines = lines_from_text(df, ["doc_id"])
    assert rows(split_sections(lines, hot_rows=20)) == rows(split_sections(lines))


def test_slugs(spark):
    titles = ["Hello, World!", "hello world", "  --  ", "Été", "a  -  b", "Hello World", "!!!", "???", "snake_case 1"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(titles)], "doc_id long, section_no long, title string")
    got = [r["slug"] for r in unique_slugs(df).orderBy("section_no").collect()]
    assert got == [
        "hello-world", "hello-world-1", "-", "t", "a-b", "hello-world-2", "section", "section-1", "snake_case-1",
    ]
    assert unique_slugs(df, hot_rows=1).orderBy("section_no").select("slug").collect() == [(s,) for s in got]
    assert df.select(slug(F.lit("x"))).first()[0] == "x"


def test_export(spark, tmp_path):
    df = spark.sql("select 1 as id, timestamp_ntz'2024-02-03 04:05:06.7' as ts")
    assert export_stamped(df, "ts", "shot").first()["name"] == "shot-2024-02-03-040506"
    write_stamped(df, str(tmp_path / "out"), "ts", "shot")
    back = spark.read.parquet(str(tmp_path / "out")).first()
    assert (back["name"], str(back["day"])) == ("shot-2024-02-03-040506", "2024-02-03")


def test_read_lines_prunes_and_pushes_down(spark, tmp_path):
    spark.createDataFrame([], LINES).write.parquet(str(tmp_path / "lines"))
    df = read_lines(spark, str(tmp_path / "lines")).where("session_id = 'a'").select("text")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(session_id,a)" in plan and "ReadSchema: struct<session_id:string,text:string>" in plan
    assert read_lines(spark, str(tmp_path / "lines"), streaming=True).isStreaming


def test_spread_reads_sizes_with_units(spark):
    from linestream.sources.tables import spread

    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("16m", "134217728b", "1g", "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert spread(spark.range(10), "id").count() == 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_a_lexicon_too_large_to_broadcast_gives_the_same(spark, rows, monkeypatch):
    """Common tokens are put in by the tasks, the others by a join; entries with spaces, gaps and unknown sources too."""
    from linestream import scale
    from linestream.operators.text import lexicon_translate

    entries = [("de", "en", f"w{i}", f"a {i}" if i % 3 else None) for i in range(60)] + [("fr", "en", "w1", "u n")]
    lexicon = spark.createDataFrame(entries, "source string, target string, token string, out string")
    texts = [(i, s, " ".join(f"w{i * j % 70}" for j in range(i % 9))) for i, s in enumerate(["de", "fr", None, "de"] * 60)]
    asked = spark.createDataFrame([*texts, (999, "de", None), (1000, "de", " w1  w2 ")], "id int, source string, text string")
    by = {(s, t): o for s, _, t, o in entries}
    want = sorted((i, " ".join(by.get((s, t)) or t for t in x.split(" "))) for i, s, x in [*texts, (1000, "de", " w1  w2 ")])
    for most in (200_000, 0, 20):
        monkeypatch.setattr(scale, "BROADCAST_ROWS", most)
        got = lexicon_translate(asked, lexicon, ["id"])
        assert sorted(tuple(r) for r in got.collect()) == want
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert most != 200_000 or "Exchange" not in plan


@pytest.mark.parametrize("most", [200_000, 0])
def test_answers_of_the_lexicon_come_with_their_lines(spark, monkeypatch, tmp_path, most):
    """So a capture does not shuffle the texts of its lines once more to join the answers to them."""
    from linestream import scale
    from linestream.plans.capture import lexicon_backend, translate_capture

    monkeypatch.setattr(scale, "BROADCAST_ROWS", most)
    lexicon = spark.createDataFrame([("de", "en", f"w{i}", f"v{i}") for i in range(0, 40, 2)], "source string, target string, token string, out string")
    texts = [("s", i // 5, i % 5, " ".join(f"w{i * j % 50}" for j in range(1 + i % 4)) if i % 7 else " ", i) for i in range(100)]
    pending = spark.createDataFrame(texts, "session_id string, frame_seq long, line_no int, text string, own int")
    word = lambda t: f"v{t[1:]}" if t.startswith("w") and int(t[1:]) < 40 and int(t[1:]) % 2 == 0 else t
    want = sorted((i, " ".join(map(word, x.split(" ")))) for *_, x, i in texts if x.strip())
    got = translate_capture(pending, lexicon_backend(lexicon, "en"), "de-DE", "en")
    assert sorted((r["own"], r["translated"]) for r in got.collect()) == want
    assert sum("Join" in line for line in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()) == (0 if most else 2)
    odd = pending.where("own < 3").withColumn("source", F.lit("de")).unionByName(pending.where("own = 3").withColumns({"text": F.lit(None).cast("string"), "source": F.lit("de")}))
    said = lexicon_backend(lexicon, "en")(odd)
    assert {r["own"]: r["answer"] for r in said.collect()}[3] is None and said.columns == [*odd.columns, "answer"] and said.count() == 4
    pending.write.parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    assert scale.is_read(read.where("own > 1").withColumn("x", F.lower("text"))) and not scale.is_read(read.groupBy("own").count())
    assert not scale.is_read(read.join(pending, "own")) and not scale.is_read(pending)

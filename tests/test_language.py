import random

import pytest
from pyspark.sql import functions as F

from linestream.functions.languages import LIKELY, likely_subtags, maximal_id, primary_subtag
from linestream.operators import language as lg


def test_maximal_and_primary(spark):
    want = {
        "en": ("en", "en-Latn-US"), "en-GB": ("en", "en-Latn-GB"), "zh": ("zh", "zh-Hans-CN"), "zh-TW": ("zh", "zh-Hant-TW"),
        "zh-Hant": ("zh", "zh-Hant-TW"), "zh-Hant-HK": ("zh", "zh-Hant-HK"), "zh_HK": ("zh", "zh-Hant-HK"), "sr": ("sr", "sr-Cyrl-RS"),
        "sr-Latn": ("sr", "sr-Latn-RS"), "pt-BR": ("pt", "pt-Latn-BR"), "es-419": ("es", "es-Latn-419"), "EN-us": ("en", "en-Latn-US"),
        "tlh": ("tlh", "tlh"), "": ("", ""), "auto": ("auto", "auto"), "sw": ("sw", "sw-Latn-TZ"), "hy": ("hy", "hy-Armn-AM"),
        "az": ("az", "az-Latn-AZ"), "az-IR": ("az", "az-Arab-IR"), "uz-AF": ("uz", "uz-Arab-AF"), "uz-Cyrl": ("uz", "uz-Cyrl-UZ"),
        "zh-SG": ("zh", "zh-Hans-SG"), "zh-Hans-TW": ("zh", "zh-Hans-TW"), "sr-ME": ("sr", "sr-Latn-ME"), "sr-Cyrl-ME": ("sr", "sr-Cyrl-ME"),
        "pa_Arab": ("pa", "pa-Arab-PK"), "tlh-Latn": ("tlh", "tlh-Latn"),
    }
    df = spark.createDataFrame([(c,) for c in want], "c string")
    got = {r[0]: (r[1], r[2]) for r in df.select("c", primary_subtag(F.col("c")), maximal_id(F.col("c"))).collect()}
    assert got == want
    table = spark.createDataFrame([*LIKELY.items(), ("tlh", "tlh-Latn-001")], "tag string, full string")
    df = spark.createDataFrame([(c,) for c in [*want, "en", None]], "code string")
    by_table = [tuple(r) for r in lg.maximal_ids(df, table).collect()]
    more = {"tlh": "tlh-Latn-001", "tlh-Latn": "tlh-Latn-001", None: None}
    assert dict(by_table) == {k: v[1] for k, v in want.items()} | more and len(by_table) == len(want) + 2


def test_likely_subtags_file(tmp_path):
    path = tmp_path / "likelySubtags.json"
    path.write_text('{"supplemental": {"likelySubtags": {"aa": "aa-Latn-ET", "zh_TW": "zh_Hant_TW"}}}')
    assert likely_subtags(str(path)) == {"aa": "aa-Latn-ET", "zh-TW": "zh-Hant-TW"}


@pytest.fixture(scope="module")
def profile(spark):
    data = [("en", "the house and the garden with the dog"), ("fr", "le chien dans la maison et les jardins"), ("de", "der hund und das haus mit dem garten")]
    return lg.language_profile(spark.createDataFrame(data * 3, "lang string, text string"))


def python_model(rows):
    grams = {}
    for lang, text in rows:
        x = text.lower()
        for i in range(max(len(x) - 2, 1)):
            grams.setdefault(x[i : i + 3], {}).setdefault(lang, 0)
            grams[x[i : i + 3]][lang] += 1
    return grams


def test_profile_counts(spark):
    import math

    data = [("en", "AbcAbc"), ("en", "ab"), ("fr", "abcd"), ("fr", "\U0001f600bc")]
    p = lg.language_profile(spark.createDataFrame(data, "lang string, text string"), ["en", "fr"])
    model = python_model(data)
    tot = {v: sum(c.get(v, 0) for c in model.values()) for v in ("en", "fr")}
    got = {r["g"]: (r["lp_0"], r["lp_1"]) for r in p.grams.collect()}
    assert got.keys() == model.keys()
    for g, c in model.items():
        for i, v in enumerate(("en", "fr")):
            assert got[g][i] == pytest.approx(math.log((c.get(v, 0) + 1) / (tot[v] + len(model))))


def test_detect_undetermined_and_threshold(spark, profile):
    df = spark.createDataFrame([(1, "the dog"), (2, "zzzzqq"), (3, ""), (4, "le chien")], "id int, text string")
    got = {r["id"]: (r["detected"], r["confidence"]) for r in lg.detect_language(df, profile, ["id"], 0.0).collect()}
    assert got[1][0] == "en" and got[4][0] == "fr" and got[2] == (None, None) and got[3] == (None, None)
    sure = {r["id"]: r["detected"] for r in lg.detect_language(df, profile, ["id"], 0.999999).collect()}
    assert set(sure.values()) == {None}


def test_ties_go_to_the_larger_code(spark):
    p = lg.language_profile(spark.createDataFrame([("aa", "xyz"), ("bb", "xyz")], "lang string, text string"))
    row = lg.detect_language(spark.createDataFrame([(1, "xyz")], "id int, text string"), p, ["id"]).first()
    assert row["detected"] == "bb" and row["confidence"] == pytest.approx(0.5)


@pytest.mark.parametrize("small", [True, False])
def test_one_pass_over_lines_and_frames_equals_two(spark, profile, small):
    """Frame scores from the lines' grams must be those of the joined text."""
    rnd = random.Random(5)
    words = "the le der dog chien hund a b et zz und maison house".split()
    data = []
    for f in range(60):
        for n in range(rnd.choice([1, 1, 2, 3, 6])):
            data.append(("s", f, n, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 1, 2, 4])))))
    data += [("t", 1, 0, "ab"), ("t", 2, 0, "a"), ("t", 2, 1, "b"), ("t", 3, 0, ""), ("t", 3, 1, ""), ("t", 3, 2, "le chien")]
    lines = spark.createDataFrame(data, "session_id string, frame_seq long, line_no int, text string")
    p = lg.Profile(profile.grams, profile.langs, profile.n, small)
    joined = lines.groupBy("session_id", "frame_seq").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n").alias("text")
    )
    ids = ["session_id", "frame_seq"]
    by_line = {tuple(r[:3]): r["detected"] for r in lg.detect_language(lines, p, [*ids, "line_no"], 0.65).collect()}
    by_frame = {tuple(r[:2]): r["detected"] for r in lg.detect_language(joined, p, ids).collect()}
    got = {tuple(r[:3]): r["source"] for r in lg.resolve_sources(lines, "auto", p).select(*ids, "line_no", "source").collect()}
    assert got == {k: v or by_frame[k[:2]] or "en-US" for k, v in by_line.items()}
    assert len({v for v in got.values()}) >= 3 and None in by_line.values()


def test_large_profile_gets_each_gram_of_a_text_once(spark, profile):
    large = lg.Profile(profile.grams, profile.langs, profile.n, False)
    data = [(1, "the the the dog and the dog"), (2, "zzzzqq"), (3, ""), (4, "le chien le chien"), (5, None), (6, "a"), (7, "th" * 3000 + " the dog")]
    df = spark.createDataFrame(data, "id int, text string")
    counted = lg._counted(df.select("id", lg._text_grams(F.lower("text"), 3).alias("g")), "g", ["id"]).collect()
    assert {(r["v"], r["n"]) for r in counted if r["id"] == 7} >= {("tht", 2999), ("hth", 2999), ("the", 1)}
    assert {(r["v"], r["n"]) for r in counted if r["id"] == 6} == {("a", 1)}
    get = lambda p: {r["id"]: (r["detected"], r["confidence"]) for r in lg.detect_language(df, p, ["id"]).collect()}
    small, forced = get(profile), get(large)
    for k, (lang, conf) in small.items():
        assert forced[k][0] == lang and forced[k][1] == (None if conf is None else pytest.approx(conf))
    assert {k for k in forced if forced[k] != (None, None)} == {1, 4, 7}


def test_configured_source_holds_for_all(spark):
    lines = spark.createDataFrame([("s", 1, 0, "le chien")], "session_id string, frame_seq long, line_no int, text string")
    assert lg.resolve_sources(lines, "ja").first()["source"] == "ja"
    with pytest.raises(ValueError):
        lg.resolve_sources(lines, "auto")


def test_catalog(spark):
    have = spark.createDataFrame([("fr",), ("fr-FR",), ("",), ("de",), ("en",), ("zh-TW",)], "code string")
    can = spark.createDataFrame([("fr",), ("en-US",), ("ja",)], "code string")
    names = spark.createDataFrame([("fr-Latn-FR", "\u00c9tats (fr)"), ("en-Latn-US", "English"), ("de-Latn-DE", "German")], "code string, name string")
    src = lg.language_catalog(have, can, names, True).orderBy("pos").collect()
    assert [(r["pos"], r["code"]) for r in src] == [(1, "auto"), (2, "en-Latn-US"), (3, "fr-Latn-FR")]
    assert src[0]["display"] == "Auto (detect)"
    dst = lg.language_catalog(have, can, names, False).orderBy("pos").collect()
    assert [r["code"] for r in dst] == ["en-Latn-US", "fr-Latn-FR", "de-Latn-DE", "zh-Hant-TW"]


def test_grams_in_bulk_equal_grams_one_by_one():
    """Texts of all lengths, without and with rare letters, in slices of a few bytes each."""
    import random
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    from linestream.functions import grams

    rnd = random.Random(5)
    texts = ["".join(rnd.choices("ab é\U0001f600\n", k=rnd.randrange(9))) for _ in range(300)] + ["", "a", "ab", "abc"]
    langs = np.array([rnd.randrange(2) for _ in texts])
    cut = lambda t, size: [t[i : i + 3] for i in range(size - 2)]
    own_grams = lambda t: cut(t, len(t)) if len(t) >= 3 else [t]
    want = Counter((g, v) for t, v in zip(texts, langs.tolist(), strict=True) for g in own_grams(t))
    for slice_, dense in ((7, 0), (64, 1 << 23), (4 << 20, 1 << 23)):
        old = grams._SLICE, grams._DENSE
        grams._SLICE, grams._DENSE = slice_, dense
        try:
            got = Counter()
            for names, table in grams.gram_counts(pa.array(["x", *texts])[1:], langs, 2, 3):
                for g, row in zip(names, table.tolist(), strict=True):
                    got.update({(g, v): c for v, c in enumerate(row) if c})
            assert got == want
            known = [g for g in sorted({g for g, _ in want}) if rnd.random() < 0.7]
            lp = np.array([[-1.0 - i, -2.0 * i] for i in range(len(known))])
            score = {g: lp[i] for i, g in enumerate(known)}
            model = grams.GramScores(known, lp, 3)
            own = np.array([rnd.randrange(len(t) + 1) for t in texts])
            alone = np.array([rnd.random() < 0.5 for _ in texts])
            k, s, fk, fs = model.sums(pa.array(texts), own, alone)
            k1, s1 = model.sums(pa.array([*texts, None]))
            assert (k1[-1], s1[-1].tolist()) == (0, [0, 0])
            for i, t in enumerate(texts):
                line = [t[: own[i]]] if own[i] < 3 else cut(t, own[i])
                frame = cut(t, len(t)) + ([t[: own[i]]] if own[i] < 3 and alone[i] else [])
                for (n, sums), all_ in (((k[i], s[i]), line), ((fk[i], fs[i]), frame), ((k1[i], s1[i]), own_grams(t))):
                    hit = [score[g] for g in all_ if g in score]
                    assert n == len(hit) and np.allclose(sums, np.sum(hit, axis=0) if hit else 0)
        finally:
            grams._SLICE, grams._DENSE = old


def test_lines_are_shuffled_once_with_their_frame(spark, profile):
    """Found languages need not be joined back; odd rows (repeated, NULL keys and texts) get what a join would give them."""
    data = [("s", 1, 0, "the dog", 1), ("s", 1, 1, "zz", 2), ("s", 1, 1, "le chien", 3), ("s", 1, None, "the", 4), ("s", None, 0, "le chien", 5)]
    data += [(None, 2, 0, "le chien", 6), ("s", 3, 0, None, 7), ("s", 3, 1, "chien", 8), ("s", 3, 2, None, 9), ("s", 4, 0, None, 10), ("s", 5, 0, "a", 11)]
    data += [("s", 6, 2, "le", 12), ("s", 6, 0, "a", 13), ("s", 6, 1, "b", 14), ("s", 7, 0, "le chien", 15), ("s", 7, 0, "le chien", 15)]
    lines = spark.createDataFrame(data, "session_id string, frame_seq long, line_no int, text string, line_lang int")
    got = lg.resolve_sources(lines, "auto", profile)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    want = lg.resolve_sources(lines, "auto", profile, checkpoint=True)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert {r["line_lang"]: r["source"] for r in got.collect()}[5] == "en-US"

"""Personal data in texts: fixed rules, and boosted trees over overlapping candidates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.llm.quality import fit_trees
from linestream.llm.spans import find, overlaps, told, trees_column

# The rules of the base.  (Runs are entered at their beginning or where the last match ended, and never
# given back: the same matches, without trying each place of a long run.)
EMAIL = "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9]){11,}+"  # shorter runs fail whole, wherever they are entered
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)
KINDS = ("email", "ip", "card", "phone")

#: Candidates: wider forms of each kind, which overlap the rules' matches and each other.
WIDE = {
    "email": "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\\x20?@\\x20?|\\x20?[\\[(](?i:at)[\\])]\\x20?)[A-Za-z0-9-]{1,63}+(?:\\.[A-Za-z0-9-]{1,63}+)*+",
    "ip": "(?<![0-9A-Fa-f:.])(?:[0-9]{1,3}+(?:\\.[0-9]{1,3}+){3}|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7})",
    "card": "(?<![0-9])[0-9]{3,6}+(?:[\\x20./-]?[0-9]{2,7}+){2,4}",
    "phone": "(?<![0-9+])[+(]?[0-9][0-9().\\x20/-]{6,20}[0-9]",
}
#: Precision over the labelled candidates that a score must have to be redacted; candidates a score must rest on.
PRECISION, LEAST_SEEN = 0.98, 20
#: Words just before a candidate that tell its kind.
CONTEXT = {
    "email": "(?i)(?:mail|contact|write)[^A-Za-z0-9]{0,3}$",
    "ip": "(?i)(?:ip|host|server|address)[^A-Za-z0-9]{0,3}$",
    "card": "(?i)(?:card|visa|pay|account)[^A-Za-z0-9]{0,3}$",
    "phone": "(?i)(?:tel|phone|call|mobile|fax|contact)[^A-Za-z0-9]{0,3}$",
}
#: Kinds whose values say little by themselves: without a telling word, and without a rule's match, they are none.
BARE = ("card", "phone")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of cards: every second digit from the right doubled, less nine above nine; divisible by ten."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """email, ip, card, phone: arrays of (s, e, v) that pass the rules."""

    def card(x: Column) -> Column:
        d = _digits(x["v"])
        return F.when(F.length(d).between(*CARD_DIGITS), luhn(d)).otherwise(False)

    return {
        "email": find(text, EMAIL, "@"),
        "ip": F.filter(find(text, IP), lambda x: x["v"].rlike(f"^{IP_PART}(?:\\.{IP_PART}){{3}}$")),
        "card": F.filter(find(text, CARD), card),
        "phone": F.filter(find(text, PHONE, "+"), lambda x: F.length(_digits(x["v"])).between(*PHONE_DIGITS)),
    }


def plausible(kind: str, v: Column) -> Column:
    """Whether a candidate, brought to the plain form of its kind, passes the rule's check of the value."""
    d = _digits(v)
    four = "^[0-9]++(?:\\.[0-9]++){3}$"
    if kind == "email":
        plain = F.regexp_replace(v, "\\x20?(?:@|[\\[(](?i:at)[\\])])\\x20?", "@")
        return plain.rlike("^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\\.)+[A-Za-z]{2,}$")
    if kind == "ip":
        group = "[0-9A-Fa-f]{1,4}"
        short = f"(?!.*::.*::){group}(?::{group})*::(?:{group}(?::{group})*)?"
        return v.rlike(f"^{IP_PART}(?:\\.{IP_PART}){{3}}$") | v.rlike(f"^(?:{group}(?::{group}){{7}}|{short})$")
    if kind == "card":
        return F.when(F.length(d).between(*CARD_DIGITS), luhn(d)).otherwise(False)
    return F.length(d).between(*PHONE_DIGITS) & ~v.rlike(four)


#: Nothing that a rule's own form gives away: no sign for "@", no leading "+", no separators.
FEATURES = ["kind", "plausible", "before", "context"]


def _features(kind: int, x: Column) -> list[Column]:
    """Few-valued traits of a candidate: its value, the character before it, and telling words there."""
    beside = lambda c: F.when(c == "", 0).when(c.rlike("\\s"), 1).when(c.rlike("[A-Za-z0-9]"), 2).otherwise(3)
    name = KINDS[kind]
    return [F.lit(kind), plausible(name, x["v"]), beside(F.right(x["c"], F.lit(1))), x["c"].rlike(CONTEXT[name])]


def candidates(text: Column, base: list[Column]) -> Column:
    """All candidates with their features, whether a rule's span overlaps them, and their label: (s, e, kind, f, y, label).

    The label is 1 where the rule of the kind matched; 0 where no rule did and the value fails the check of its kind, or
    is a bare number without a telling word.  Other candidates have none: that no rule matched says nothing against them.
    """

    def proposed(kind: int) -> Column:
        def shape(x: Column) -> Column:
            return F.struct(
                x["s"].alias("s"),
                x["e"].alias("e"),
                F.lit(kind).alias("kind"),
                F.array(*[f.cast("int") for f in _features(kind, x)]).alias("f"),
                overlaps(x, base).alias("y"),
                overlaps(x, [base[kind]]).alias("own"),
            )

        def labelled(c: Column) -> Column:
            none = c["f"][1] == 0
            if KINDS[kind] in BARE:
                none = none | (c["f"][3] == 0)
            label = F.when(c["own"], 1).when(~c["y"] & none, 0)
            return F.struct(*[c[n].alias(n) for n in ("s", "e", "kind", "f", "y")], label.alias("label"))

        return F.transform(F.transform(find(text, WIDE[KINDS[kind]], context=True), shape), labelled)

    return F.concat(*[proposed(i) for i in range(len(KINDS))])


def train(found: DataFrame):
    """Trees and, for each kind, the least margin at which at least ``PRECISION`` of the candidates are labelled.

    Labels are those of ``candidates``.  All labelled ones count: they are summed by their features, of which there are
    few combinations however large the data is, and the trees are fitted on these weighted rows.
    """
    # The outer form: for the inner one Spark adds a filter on the array, for which all candidates would be found again.
    seen = found.select(F.explode_outer("cand").alias("c")).where("c.label is not null").groupBy("c.f").agg(
        F.sum(F.col("c.label").cast("long")).alias("yes"), F.count("*").alias("n")
    )
    rows = sorted((list(r["f"]), r["yes"], r["n"]) for r in seen.collect())
    if not rows:
        return None, {}
    x = np.array([r[0] for r in rows], np.float64)
    yes, n = (np.array([r[i] for r in rows], np.float64) for i in (1, 2))
    trees = fit_trees(np.concatenate([x, x]), np.concatenate([np.ones(len(x)), np.zeros(len(x))]), np.concatenate([yes, n - yes]))
    margin = trees.margin(x)
    least = {}
    for k in range(len(KINDS)):
        mine = np.flatnonzero(x[:, 0] == k)
        order = mine[np.argsort(-margin[mine], kind="stable")]
        good = (np.cumsum(yes[order]) >= PRECISION * np.cumsum(n[order])) & (np.cumsum(n[order]) >= LEAST_SEEN)
        last = np.append(margin[order][1:] < margin[order][:-1], True)  # equal margins stand or fall together
        if (good & last).any():
            least[k] = float(margin[order][np.flatnonzero(good & last)[-1]])
    return trees, least


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` with a column of spans for each kind and ``added`` (array of s, e, kind); null texts become empty.

    Added are the candidates at or above their kind's threshold that overlap no span of the rules, nor one added before
    them: of overlapping ones the first, then the longest.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.withColumn("text", text)
    # Columns of their own, used more than once: so they are worked out once a row, not again inside the lambdas.
    found = found.withColumns(base_spans(F.col("text")))
    found = found.withColumn("cand", candidates(F.col("text"), [F.col(k) for k in KINDS]))
    trees, least = train(found)
    if trees is None or not least:
        return found.withColumn("added", F.array().cast("array<struct<s:int,e:int,kind:int>>")).drop("cand")
    def strong(c: Column) -> Column:
        margin = trees_column(trees, [c["f"][i] for i in range(len(FEATURES))])
        out = F.lit(False)
        for k, edge in least.items():
            out = out | ((c["kind"] == k) & (margin >= edge - 1e-9))
        return out & ~c["y"]

    shape = lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("l"), c["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(F.filter("cand", strong), shape))
    kept = "array<struct<s:int,e:int,kind:int>>"

    def apart(acc: Column, c: Column) -> Column:
        one = F.array(F.struct(c["s"].alias("s"), (-c["l"]).alias("e"), c["kind"].alias("kind")))
        free = (F.size(acc) == 0) | (F.element_at(acc, -1)["e"] <= c["s"])
        return F.when(F.coalesce(free, F.lit(True)), F.concat(acc, one)).otherwise(acc)

    return found.withColumn("added", F.aggregate(ordered, F.array().cast(kept), apart)).drop("cand")


def scan_personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts count as empty: no spans, the hash of nothing; null ids and repeated rows are rows like others; without
    candidates nothing is added; an empty table gives an empty result; other columns are ignored.
    """
    found = find_personal_data(docs.select("doc_id", "text"))
    base = {k: F.col(k) for k in KINDS}
    mine = lambda i: F.filter("added", lambda a: a["kind"] == i)
    bare = lambda a: F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    every = {k: F.concat(bare(base[k]), bare(mine(i))) for i, k in enumerate(KINDS)}
    return found.select(
        "doc_id",
        *[F.size(base[k]).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(every).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans become one mark, of the first.

    Texts without spans and null texts stay as they are; ``n_chars``, where there is one, follows a changed text.
    """
    cols = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row")  # so that no name of ``docs`` clashes
    found = find_personal_data(docs.select(whole, F.col("text")))
    tag = lambda a, i: F.transform(a, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("l"), F.lit(i).alias("kind")))
    parts = [tag(F.col(k), i) for i, k in enumerate(KINDS)]
    parts.append(F.transform("added", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("l"), x["kind"].alias("kind"))))
    every = F.array_sort(F.concat(*parts))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, x: Column) -> Column:
        new = x["s"] >= acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.element_at(names, x["kind"] + 1))
        out = F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], -x["l"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    tail = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    found = found.withColumn("__all", every)
    found = found.withColumn("__new", F.when(F.size("__all") > 0, F.aggregate("__all", start, step, tail)).otherwise(F.col("__row.text")))
    put = {"text": F.col("__new")}
    if "n_chars" in cols:
        same = F.size("__all") == 0
        put["n_chars"] = F.when(same, F.col("__row.n_chars")).otherwise(F.length("__new")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[put.get(c, F.col(f"__row.`{c}`")).alias(c) for c in cols])

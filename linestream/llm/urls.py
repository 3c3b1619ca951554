"""URL filter: rules by host and path, and link-graph propagation for the urls no rule speaks about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linestream.llm.common import ascii_lower, written

#: Rules (host, path, verdict) become part of the plan, so their number is bounded.
MOST_RULES = 1_000
#: Share of a host's mass that its links carry on (percent), and all mass, in whole units.
DAMPING, MASS = 85, 10**15
#: Rounds that the SQL form writes out; enough where no chain of links is longer, as masses then no longer change.
SQL_ROUNDS = 8
#: A host is blocked whose distrust is above its trust and at least this part of (one over) the mean mass of a host.
PART = 100
LINK = "(?i)href\\s*=\\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/\"'?#\\s>]+)"
_HOST_PATH = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without one or null: empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _HOST_PATH, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> Column:
    """The longest rule that fits (struct rule, verdict), or null: its host or a subdomain, and a path that starts with its path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of different hosts, each pair once: hosts that pages link to by full urls, and each host's parent domain.

    A subdomain counts as linking to its parent of two labels or more: it is the parent's by delegation.  Pairs are made
    distinct map-side before the shuffle, so a host with very many pages sends each of its links once a task.
    """
    linked = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda h: ascii_lower(h))
    direct = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.coalesce(linked, F.array().cast("array<string>"))).alias("dst"))
    direct = direct.where("src <> dst and dst <> ''").distinct()
    labels = F.split("h", "\\.")
    hosts = pages.select(F.col("host").alias("h")).distinct().union(direct.select(F.col("dst").alias("h")).distinct())
    # A host and its parents, link by link.
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(chain[i - 1].alias("src"), chain[i].alias("dst")))
    up = hosts.where(F.size(labels) > 2).select(F.explode(steps).alias("e")).select("e.src", "e.dst")
    return direct.union(up.where("src <> '' and dst <> '' and src <> dst")).distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from trusted seeds along links, and from blocked seeds against them.

    ``seeds``: host, good, bad (0 or 1).  Masses are whole numbers, split by whole division: sums do not depend on the order of
    rows, so lost and repeated tasks change nothing.  A round is one pass over the edges joined with both ends, and a sum
    combined map-side; each is written to the shared folder.

    Rounds go on until what they move cannot reach the threshold of a verdict any more: a round moves at most
    ``DAMPING`` percent of what the one before moved, so all that is still to come is below ``DAMPING`` / (100 - ``DAMPING``)
    times it.  One sum a round tells; on links without circles the masses stand still in the end.  ``rounds`` asks for a number
    of rounds instead.
    """
    edges = written(edges, "edges", "snappy")
    out_links = edges.groupBy("src").agg(F.count("*").alias("outs"))
    in_links = edges.groupBy("dst").agg(F.count("*").alias("ins"))
    edges = written(edges.join(out_links, "src").join(in_links, "dst"), "weighted", "snappy")
    n_good, n_bad = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    share = lambda flag, n: F.col(flag).cast("long") * F.lit(MASS // max(n, 1))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    named = ends.join(seeds, "host", "full_outer")
    nodes = named.select(
        "host", F.coalesce(share("good", n_good), F.lit(0).cast("long")).alias("good"), F.coalesce(share("bad", n_bad), F.lit(0).cast("long")).alias("bad")
    )
    now = written(nodes.withColumns({"trust": F.col("good"), "distrust": F.col("bad")}), "nodes", "snappy")
    carry = lambda mass, links: F.expr(f"{mass} * {DAMPING} div 100 div {links}")
    unit, done = MASS // (PART * max(now.count(), 1)), 0
    while rounds is None or done < rounds:
        done += 1
        a = now.select(F.col("host").alias("src"), "trust")
        b = now.select(F.col("host").alias("dst"), "distrust")
        sent = edges.join(a, "src").join(b, "dst").where("trust > 0 or distrust > 0")
        zero = F.lit(0).cast("long")
        both = F.array(
            F.struct(F.col("dst").alias("host"), carry("trust", "outs").alias("t"), zero.alias("d")),
            F.struct(F.col("src").alias("host"), zero.alias("t"), carry("distrust", "ins").alias("d")),
        )
        got = sent.select(F.explode(both).alias("x")).groupBy("x.host").agg(F.sum("x.t").alias("t"), F.sum("x.d").alias("d"))
        start = lambda seed, add: F.expr(f"{seed} * {100 - DAMPING} div 100") + F.coalesce(F.col(add), zero)
        old = F.struct(F.col("trust").alias("t"), F.col("distrust").alias("d")).alias("old")
        now = now.select("host", "good", "bad", old).join(got, "host", "left")
        now = written(now.select("host", "good", "bad", start("good", "t").alias("trust"), start("bad", "d").alias("distrust"), "old"), "nodes", "snappy")
        change = F.abs(F.col("trust") - F.col("old.t")) + F.abs(F.col("distrust") - F.col("old.d"))
        moved = now.agg(F.sum(change)).first()[0] or 0
        now = now.drop("old")
        if rounds is None and (moved == 0 or moved * DAMPING < unit * (100 - DAMPING)):
            break
    return now.select("host", "trust", "distrust")


def filter_urls(pages: DataFrame, rules, rounds: int | None = None) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust.

    Rules (host, path, allow or block) speak first.  Hosts most of whose pages they block are blocked seeds, others with an
    allowed page trusted ones.  A url without a rule is blocked when its host's distrust is above its trust and the
    threshold (see ``PART``), else allowed.

    Null urls and urls without ``://`` have an empty host and path and are allowed; null html has no links; repeated rows are
    judged alike and do not weigh as links; without seeds no mass flows; an empty table gives an empty result.
    """
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    seen = base.select("page_id", "host", "path", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    tally = seen.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("r.verdict") == "block", 1)).alias("b"), F.count(F.when(F.col("r.verdict") == "allow", 1)).alias("a")
    )
    bad = F.col("b") * 2 > F.col("n")
    seeds = written(tally.select("host", ((F.col("a") > 0) & ~bad).cast("long").alias("good"), bad.cast("long").alias("bad")), "seeds", "snappy")
    ranks = propagate(host_edges(base), seeds, rounds)
    hosts = max(ranks.count(), 1)
    out = seen.join(ranks, "host", "left")
    zero = F.lit(0).cast("long")
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    by_graph = F.when((distrust > trust) & (distrust >= MASS // (PART * hosts)), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", by_graph).alias("verdict"),
        trust.alias("trust"), distrust.alias("distrust"),
    )


def filter_sql(rules, rounds: int = SQL_ROUNDS) -> str:
    """The same over the view ``pages`` in DuckDB SQL, the rounds written out."""
    longest = sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r), reverse=True)
    fits = "(host = '{0}' or ends_with(host, '.{0}')) and starts_with(path, '{1}')"
    rule = "case" + "".join(f" when {fits.format(h, p)} then '{h + p}'" for h, p, _ in longest) + " end"
    said = "case rule" + "".join(f" when '{h + p}' then '{v}'" for h, p, v in rules) + " end"
    pattern = _HOST_PATH.replace("'", "''")
    link = LINK.replace("'", "''")
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
with p0 as (
  select page_id, coalesce({low.format(f"regexp_extract(url, '{pattern}', 1)")}, '') host,
    coalesce(regexp_extract(url, '{pattern}', 2), '') path, html from pages),
p as (select *, {said} said from (select *, {rule} rule from p0)),
tally as (
  select host, count(*) n, count(*) filter (said = 'block') b, count(*) filter (said = 'allow') a from p where host <> '' group by host),
seeds as (select host, (a > 0 and b * 2 <= n)::bigint good, (b * 2 > n)::bigint bad from tally),
direct as (
  select distinct src, dst from (
    select host src, unnest(list_transform(regexp_extract_all(html, '{link}', 1), lambda h: {low.format("h")})) dst from p where host <> '')
  where src <> dst and dst <> ''),
hosts as (select host h from p union select dst from direct),
parents as (
  select array_to_string(l[i:], '.') src, array_to_string(l[i + 1:], '.') dst
  from (select string_split(h, '.') l, unnest(range(1, len(string_split(h, '.')) - 1)) i from hosts)),
edge0 as (select src, dst from direct union select src, dst from parents where src <> '' and dst <> '' and src <> dst),
e as (select *, count(*) over (partition by src) outs, count(*) over (partition by dst) ins from edge0),
n0 as (
  select host, coalesce(good, 0) * ({MASS} // greatest(1, (select coalesce(sum(good), 0) from seeds)))::bigint good,
    coalesce(bad, 0) * ({MASS} // greatest(1, (select coalesce(sum(bad), 0) from seeds)))::bigint bad
  from (select src host from e union select dst from e) full join seeds using (host)),
r0 as materialized (select host, good, bad, good t, bad d from n0)"""
    for i in range(1, rounds + 1):
        sql += f""",
r{i} as materialized (
  select r.host, r.good, r.bad, (r.good * {100 - DAMPING} // 100 + coalesce(x.t, 0))::bigint t, (r.bad * {100 - DAMPING} // 100 + coalesce(y.d, 0))::bigint d
  from r{i - 1} r
  left join (select e.dst host, sum(a.t * {DAMPING} // 100 // outs) t from e join r{i - 1} a on a.host = e.src group by 1) x on x.host = r.host
  left join (select e.src host, sum(a.d * {DAMPING} // 100 // ins) d from e join r{i - 1} a on a.host = e.dst group by 1) y on y.host = r.host)"""
    return sql + f"""
select page_id, p.host, path, rule, coalesce(said, case when coalesce(d, 0) > coalesce(t, 0)
    and coalesce(d, 0) >= {MASS} // ({PART} * greatest(1, (select count(*) from r{rounds}))) then 'block' else 'allow' end) verdict,
  coalesce(t, 0)::bigint trust, coalesce(d, 0)::bigint distrust
from p left join r{rounds} r on r.host = p.host
"""

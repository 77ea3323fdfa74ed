"""Features of record pairs: names, addresses, numbers, token statistics, collective support, structure and siblings.

A pair has s1_id, q_id, country, src and, with 1 for the reference record and q for the query: name_core n1 nq, name_full f1 fq, legal l1 lq, addr_core a1 aq,
state st1 stq, nums u1 uq, alpha_comps c1 cq, addr_empty e1 e2. Where a side is empty a comparison is -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import arrays
from kinloom.operators import blocking

#: Pseudo-count towards the country's prior in token statistics.
SMOOTH = 20.0
#: House-number shifts of decoys beside 1 and 2.
DECOY_SHIFTS = [3, 4, 5, 7, 9, 11, 13, 21]


def words(col: str | Column) -> Column:
    """The distinct words of a text, in order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_distinct(F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda t: t != ""))


def parts(col: str, by: str) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(F.col(col), F.lit("")), by), lambda t: t != ""))


def first_number(col: str) -> Column:
    """The first number of a list as text; null where it is none."""
    return F.get(F.split(F.coalesce(F.col(col), F.lit("")), " "), F.lit(0)).try_cast("long")


def number_features(u1: str, uq: str) -> dict[str, Column]:
    """num_jacc over all numbers; num_first_eq and num_min_rel over the first four of at most eight digits."""
    head = lambda u: F.slice(F.transform(F.filter(F.split(u, " "), lambda t: F.length(t).between(1, 8)), lambda t: t.cast("double")), 1, 4)
    a, b = head(u1), head(uq)
    first = F.array_contains(b, F.get(a, F.lit(0))) | F.array_contains(a, F.get(b, F.lit(0)))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return {"num_jacc": arrays.jaccard(parts(u1, " "), parts(uq, " ")), "num_first_eq": F.when(some, first.cast("double")).otherwise(-1.0), "num_min_rel": arrays.least_relative_gap(a, b)}


def same_or_unknown(a: str, b: str) -> Column:
    """1 or 0 for equal or not, -1 where either is empty."""
    return F.when((F.col(a) == "") | (F.col(b) == ""), -1).otherwise((F.col(a) == F.col(b)).cast("int"))


def pair_features(pairs: DataFrame) -> DataFrame:
    """The pair features that need no string scorer; pairs also has q_nonascii and the counts s1_names, s1_names_in_state and q_names_in_s1."""
    log = lambda c: F.log1p(F.col(c).cast("double"))
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1))).cast("long")
    return pairs.select(
        "s1_id", "q_id", (F.col("n1") == F.col("nq")).cast("int").alias("nc_eq"), same_or_unknown("l1", "lq").alias("legal_eq"), F.length("n1").cast("long").alias("nc_len1"), F.length("nq").cast("long").alias("nc_len2"),
        same_or_unknown("st1", "stq").alias("state_eq"), F.round(arrays.jaccard(parts("c1", r"\|"), parts("cq", r"\|")), 6).alias("city_jacc"), F.round(arrays.jaccard(words("a1"), words("aq")), 6).alias("addr_tok_jacc"),
        *(F.round(c, 6).alias(n) for n, c in number_features("u1", "uq").items()), F.col("e2").alias("q_addr_empty"), count("uq").alias("q_nums_n"), count("u1").alias("s1_nums_n"), "src", F.col("q_nonascii").cast("int").alias("q_nonascii"),
        F.round(log("s1_names"), 6).alias("s1_name_cnt"), F.round(log("s1_names_in_state"), 6).alias("s1_name_state_cnt"), F.round(log("q_names_in_s1"), 6).alias("q_name_in_s1"),
    )


def extra_words(pairs: DataFrame) -> DataFrame:
    """(country, s1_id, q_id, numeq, side, tok, kind, pos): a row for each word that only the query (xq) or only the reference record (x1) has.

    numeq: whether the query has the record's first number (null: a side has none). kind: a where the other side has no word of its own, else s.
    pos: the word is its name's first (P), last (S) or another (M).
    """
    t1, tq = F.filter(F.split("f1", " "), lambda t: t != ""), F.filter(F.split("fq", " "), lambda t: t != "")
    numeq = F.when((F.col("u1") != "") & (F.col("uq") != ""), F.array_contains(F.split("uq", " "), F.get(F.split("u1", " "), F.lit(0))).cast("double"))
    base = pairs.select("country", "s1_id", "q_id", numeq.alias("numeq"), t1.alias("t1"), tq.alias("tq")).withColumns({"xq": F.array_except("tq", "t1"), "x1": F.array_except("t1", "tq")})
    side = lambda name, own, other: F.struct(F.lit(name).alias("side"), F.col(own).alias("own"), F.col(name).alias("toks"), F.when(F.size(other) == 0, "a").otherwise("s").alias("kind"))
    each = base.select("country", "s1_id", "q_id", "numeq", F.explode(F.array(side("xq", "tq", "x1"), side("x1", "t1", "xq"))).alias("x"))
    each = each.select("country", "s1_id", "q_id", "numeq", "x.side", "x.own", "x.kind", F.explode("x.toks").alias("tok"))
    pos = F.when(F.element_at("own", 1) == F.col("tok"), "P").when(F.element_at("own", -1) == F.col("tok"), "S").otherwise("M")
    return each.select("country", "s1_id", "q_id", "numeq", "side", "tok", "kind", pos.alias("pos"))


def token_tables(extra: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the extra words of top pairs: by country and side the prior; by word as well rate, rel and lfreq; by kind and pos as well krel and klfreq."""
    prior = extra.groupBy("country", "side").agg(F.avg("numeq").alias("prior"))
    known = F.coalesce(F.sum("numeq"), F.lit(0.0)).alias("s"), F.count("numeq").alias("k"), F.count(F.lit(1)).alias("n")
    fine = extra.groupBy("country", "side", "tok", "kind", "pos").agg(*known)
    rate = (F.col("s") + SMOOTH * F.col("prior")) / (F.col("k") + SMOOTH)
    log = F.log1p(F.col("n").cast("double"))
    # the coarse table adds up the fine one, so that extra words are counted once
    coarse = fine.groupBy("country", "side", "tok").agg(*(F.sum(c).alias(c) for c in ("s", "k", "n"))).join(prior, ["country", "side"])
    words_ = coarse.select("country", "side", "tok", rate.alias("rate"), F.try_divide(rate, F.col("prior")).alias("rel"), log.alias("lfreq"), "prior")
    in_place = fine.join(prior, ["country", "side"]).select("country", "side", "tok", "kind", "pos", F.try_divide(rate, F.col("prior")).alias("krel"), log.alias("klfreq"))
    return prior, words_, in_place


TOKEN_FEATURES = ["n", "rmin", "rmean", "relmin", "relmean", "fmax", "krelmin", "krelmean", "kfmin"]


def token_features(pairs: DataFrame, tops: DataFrame) -> DataFrame:
    """s1_id, q_id and TOKEN_FEATURES for either side; words without statistics count as the prior, 1 and 0; a side without extra words has 0 words and else -1."""
    prior, table, in_place = token_tables(extra_words(tops))
    e = extra_words(pairs).join(table.drop("prior"), ["country", "side", "tok"], "left").join(in_place, ["country", "side", "tok", "kind", "pos"], "left").join(prior, ["country", "side"], "left")
    e = e.select("s1_id", "q_id", "side", F.coalesce("rate", "prior").alias("rate"), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in (("rel", 1.0), ("lfreq", 0.0), ("krel", 1.0), ("klfreq", 0.0))))
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    found = []
    for s in ("xq", "x1"):
        made = [F.count_if(F.col("side") == s), F.min(of(s, "rate")), F.avg(of(s, "rate")), F.min(of(s, "rel")), F.avg(of(s, "rel")), F.max(of(s, "lfreq")), F.min(of(s, "krel")), F.avg(of(s, "krel")), F.min(of(s, "klfreq"))]
        found += [c.alias(f"{s}_{n}") for n, c in zip(TOKEN_FEATURES, made, strict=True)]
    agg = e.groupBy("s1_id", "q_id").agg(*found)
    out = [F.coalesce(f"{s}_{n}", F.lit(0)).alias(f"{s}_{n}") if n == "n" else F.round(F.coalesce(f"{s}_{n}", F.lit(-1.0)), 6).alias(f"{s}_{n}") for s in ("xq", "x1") for n in TOKEN_FEATURES]
    return pairs.select("s1_id", "q_id").join(agg, ["s1_id", "q_id"], "left").select("s1_id", "q_id", *out)


def collective(scored: DataFrame, q: str = "s23_id", s1: str = "s1_id") -> DataFrame:
    """What a query's and a record's other candidates say about a pair (p, src 2 or 3): conditional counts over three windows instead of joins."""
    by_q, by_s1 = Window.partitionBy(q), Window.partitionBy(s1)
    d = scored.withColumns({"q_rank": F.row_number().over(by_q.orderBy(F.col("p").desc(), s1)).cast("long"), "q_gap_best": F.round(F.col("p") - F.max("p").over(by_q), 6), "q_n": F.count(F.lit(1)).over(by_q)})
    first = F.col("q_rank") == 1
    counts = {f"{name}{src}": F.count_if(first & (F.col("p") >= th) & (F.col("src") == src)).over(by_s1) for name, th in (("hi", 0.9), ("mid", 0.5)) for src in (2, 3)}
    d = d.withColumns({"q_p2": F.coalesce(F.max(F.when(F.col("q_rank") == 2, F.col("p"))).over(by_q), F.lit(0.0)), "s1_n": F.count(F.lit(1)).over(by_s1), "s1_gap_best": F.round(F.col("p") - F.max("p").over(by_s1), 6)} | counts)
    d = d.withColumn("s1_src_rank", F.row_number().over(Window.partitionBy(s1, "src").orderBy(F.col("p").desc(), q)).cast("long"))
    for name, th in (("hi", 0.9), ("mid", 0.5)):
        own, other = F.when(F.col("src") == 2, F.col(f"{name}2")).otherwise(F.col(f"{name}3")), F.when(F.col("src") == 2, F.col(f"{name}3")).otherwise(F.col(f"{name}2"))
        d = d.withColumns({f"s1_{name}_same": own - (first & (F.col("p") >= th)).cast("long"), f"s1_{name}_other": other})
    d = d.withColumn("s1_hi_tot", F.col("s1_hi_same") + F.col("s1_hi_other"))
    # the strongest other record of the query: its best, or its second for the best itself
    at = lambda c, r: F.max(F.when(F.col("q_rank") == r, F.col(c))).over(by_q)
    rival = lambda c: F.coalesce(F.when(first, at(c, 2)).otherwise(at(c, 1)), F.lit(-1).cast("long"))
    d = d.withColumns({"alt_hi_tot": rival("s1_hi_tot"), "alt_hi_same": rival("s1_hi_same")})
    return d.select(s1, q, "q_rank", "q_gap_best", "q_p2", "q_n", "s1_n", "s1_hi_same", "s1_hi_other", "s1_mid_same", "s1_mid_other", "s1_src_rank", "s1_gap_best", "s1_hi_tot", "alt_hi_tot", "alt_hi_same")


def struct_features(pairs: DataFrame) -> DataFrame:
    """nrel_c (0 equal, 1 up to 25 above, 2 up to 25 below, 3 else, 4 unknown), words added and dropped, the shift (99 or -99 beyond 30; -99 unknown), decoy shifts, the ratio."""
    a, b = first_number("u1"), first_number("uq")
    d = b - a
    relation = F.when(a.isNull() | b.isNull(), 4).when(d == 0, 0).when(d.between(1, 25), 1).when(d.between(-25, -1), 2).otherwise(3)
    shift = F.when(F.abs(d) <= 30, d).when(d > 0, F.lit(99)).otherwise(F.lit(-99)).cast("long")
    return pairs.select(
        "s1_id", "q_id", relation.alias("nrel_c"), F.size(F.array_except(words("nq"), words("n1"))).cast("long").alias("add_n"), F.size(F.array_except(words("n1"), words("nq"))).cast("long").alias("drop_n"),
        shift.alias("ndiff"), d.isin(DECOY_SHIFTS).cast("int").alias("nd3"), F.round(F.try_divide(b.cast("double"), a.cast("double")), 6).alias("nratio"),
    )


def sibling_features(pairs: DataFrame) -> DataFrame:
    """How many other queries of the record have the words that this one adds, lack those that it drops, and share its first number and its name."""
    d = pairs.select("s1_id", "q_id", "nq", words("n1").alias("t1"), words("nq").alias("tq"), F.get(F.split("uq", " "), F.lit(0)).alias("fq"))
    by = Window.partitionBy("s1_id")
    d = d.withColumns({"nx": F.count(F.lit(1)).over(by), "sib_num": F.when(F.col("fq").isNull(), F.lit(-1)).otherwise(F.count(F.lit(1)).over(Window.partitionBy("s1_id", "fq")) - 1), "sib_name": F.count(F.lit(1)).over(Window.partitionBy("s1_id", "nq")) - 1})
    marked = F.concat(F.transform("tq", lambda t: F.struct(t.alias("tok"), F.when(F.array_contains("t1", t), "both").otherwise("add").alias("how"))), F.transform(F.array_except("t1", "tq"), lambda t: F.struct(t.alias("tok"), F.lit("drop").alias("how"))))
    each = d.select("s1_id", "q_id", "nx", F.explode(marked).alias("m")).select("s1_id", "q_id", "nx", "m.tok", "m.how")
    # one window tells added words how many have them and dropped ones how many do
    each = each.withColumn("ct", F.count_if(F.col("how") != "drop").over(Window.partitionBy("s1_id", "tok"))).where("how <> 'both'")
    added, lack = F.when(F.col("how") == "add", F.col("ct") - 1), F.when(F.col("how") == "drop", F.col("nx") - F.col("ct") - 1)
    agg = each.groupBy("s1_id", "q_id").agg(F.min(added).alias("sib_add_min"), F.max(added).alias("sib_add_max"), F.min(lack).alias("sib_drop_min"), F.max(lack).alias("sib_drop_max"))
    names = ["sib_add_min", "sib_add_max", "sib_drop_min", "sib_drop_max"]
    return d.select("s1_id", "q_id", "sib_num", "sib_name").join(agg, ["s1_id", "q_id"], "left").na.fill(-1, names)


def group_siblings(s: DataFrame, o: DataFrame, on: list[str]) -> DataFrame:
    """sibling_features of all pairs of a record (s1_id, n1) and a query (q_id, nq, uq) that agree in the columns on.

    All records of a group have the group's queries, so words, names and numbers are counted by group; what a name adds and lacks is found once for each two names, and pairs
    follow from arrays of ids.
    """
    ones = F.count(F.lit(1))
    q = o.select(*on, "q_id", "nq", F.get(F.split("uq", " "), F.lit(0)).alias("fq"))
    numbers = q.groupBy(*on, "fq").agg((ones - 1).alias("sib_num"))
    q = q.join(numbers, [*on, "fq"], "left").select(*on, "q_id", "nq", F.coalesce("sib_num", F.lit(-1)).alias("sib_num"))
    names = q.groupBy(*on, "nq").agg((ones - 1).alias("sib_name"))
    each = names.select(*on, "nq", "sib_name", F.explode(words("nq")).alias("tok"))
    counts = each.groupBy(*on, "tok").agg(F.sum(F.col("sib_name") + 1).alias("ct"))

    def counted(name: str, df: DataFrame) -> DataFrame:
        told = df.select(*on, name, F.explode(words(name)).alias("tok")).join(counts, [*on, "tok"], "left").groupBy(*on, name).agg(F.collect_list(F.struct("tok", F.coalesce("ct", F.lit(0)).alias("ct"))).alias(f"t_{name}"))
        return df.join(told, [*on, name], "left").withColumn(f"t_{name}", F.coalesce(f"t_{name}", F.array().cast("array<struct<tok:string,ct:bigint>>")))

    left = counted("n1", s.select(*on, "n1").distinct()).join(names.groupBy(*on).agg(F.sum(F.col("sib_name") + 1).alias("nx")), on)
    left = blocking.held(s, [*on, "n1"], "s1_id", F.col("s1_id"), "s1_ids").join(left, [*on, "n1"])
    right = blocking.held(q, [*on, "nq"], "q_id", F.struct("q_id", "sib_num"), "asked").join(counted("nq", names), [*on, "nq"])
    met = blocking.class_pairs(left, right, on, "s1_ids")
    alone = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.col(f"{b}.tok"), x["tok"]))
    added, lack = F.transform(alone("t_nq", "t_n1"), lambda x: x["ct"] - 1), F.transform(alone("t_n1", "t_nq"), lambda x: F.col("nx") - x["ct"] - 1)
    ends = [F.coalesce(f(c), F.lit(-1)).alias(f"sib_{n}_{e}") for n, c in (("add", added), ("drop", lack)) for e, f in (("min", F.array_min), ("max", F.array_max))]
    met = met.select("s1_ids", "asked", "sib_name", *ends)
    rest = met.columns[2:]
    each = met.select(F.explode("s1_ids").alias("s1_id"), "asked", *rest).select("s1_id", F.explode("asked").alias("x"), *rest)
    return each.select("s1_id", "x.q_id", "x.sib_num", *rest)


def shift_cells(top: DataFrame) -> DataFrame:
    """top with dg (how far the first numbers are apart: d1, d2, d3 for decoy shifts, dx up to 25, else null), up, leg (the legal forms) and nsame."""
    d = first_number("uq") - first_number("u1")
    far = F.abs(d)
    dg = F.when(far == 1, "d1").when(far == 2, "d2").when(far.isin(DECOY_SHIFTS), "d3").when(far.between(1, 25), "dx")
    leg = F.when(F.col("l1") == F.col("lq"), "same").when(F.col("l1") == "", "add").when(F.col("lq") == "", "drop").otherwise("chg")
    return top.withColumns({"dg": dg, "up": d > 0, "leg": leg, "nsame": F.col("n1") == F.col("nq")})


def learned_states(s1: DataFrame, queries: DataFrame, truth: DataFrame, least_last: int = 1000, share_last: float = 0.6, least_votes: int = 200, purity: float = 0.95, in_s1: float = 0.2) -> DataFrame:
    """(country, comp, state): which address components name a state, learned from matched records.

    s1, queries: (s1_id or q_id, country, comps). A reference component without digits that is last least_last times, and in share_last of the records that have it, is a
    state by its own name. A matched query's first and last component vote for the record's state; a spelling stays with least_votes votes for its best state, this
    share of all its votes, and if the record's address seldom has it too (cities do) or it is the state's own name.
    """
    last = s1.select("s1_id", "country", "comps", F.try_element_at("comps", F.lit(-1)).alias("state")).where(~F.col("state").rlike(r"\d"))
    named = last.groupBy("country", "state").agg(F.count(F.lit(1)).alias("n_last")).where(F.col("n_last") >= least_last)
    seen = s1.select("country", F.explode(F.array_distinct("comps")).alias("state")).groupBy("country", "state").agg(F.count(F.lit(1)).alias("n_all"))
    canon = named.join(seen, ["country", "state"]).where(F.col("n_last") / F.col("n_all") >= share_last).select("country", "state")
    homes = last.join(canon, ["country", "state"], "left_semi").withColumnRenamed("comps", "comps1")
    asked = truth.join(homes, "s1_id").join(queries.select("q_id", "comps"), "q_id")
    ends = F.explode(F.array(F.try_element_at("comps", F.lit(1)), F.try_element_at("comps", F.lit(-1)))).alias("comp")
    votes = asked.select("country", "state", "comps1", ends).where(F.col("comp").isNotNull() & ~F.col("comp").rlike(r"\d"))
    counts = votes.groupBy("country", "comp", "state").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_contains("comps1", F.col("comp")).cast("double")).alias("in_s1"))
    best = counts.groupBy("country", "comp").agg(F.sum("n").alias("tot"), F.min_by(F.struct("state", "n", "in_s1"), F.struct(-F.col("n"), "state")).alias("b"))
    kept = best.where((F.col("b.n") >= least_votes) & (F.col("b.n") / F.col("tot") >= purity) & ((F.col("b.in_s1") <= in_s1) | (F.col("comp") == F.col("b.state"))))
    learned = kept.select("country", "comp", F.col("b.state").alias("state"))
    own = canon.select("country", F.col("state").alias("comp"), "state").join(learned, ["country", "comp"], "left_anti")
    return learned.unionByName(own)

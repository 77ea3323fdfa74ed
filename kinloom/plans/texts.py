"""Names, addresses, keys, token sets and scorers on parts, documents, pages and literal cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.fixtures import PE, parts_entities, table
from kinloom.functions import arrays, similarity, text
from kinloom.operators import blocking
from kinloom.registry import REGISTRY

q = REGISTRY.query
# Part names and business-like variants of them; the same in both engines.
NAMES = "nm AS (SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'The ' || p_name || ' Co.' WHEN 1 THEN p_name || ' & Sons L.L.C.' WHEN 2 THEN p_name || ' Inc dba Bar Shop' WHEN 3 THEN 'Limited' WHEN 4 THEN 'www.' || p_name || '.co.in #12' WHEN 5 THEN p_name || '  Société S.A.R.L.' WHEN 6 THEN 'Œuvre ' || p_name || ' f k a Old Shree Pvt. Ltd' WHEN 7 THEN 'श्री ' || p_name || ' M/S' ELSE p_name || ' + Straße P.L.L.C t a The End a k a It' END AS name FROM part)"
ADDRS = "ad AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '00' || p_size || ' Main St., null, ' || p_type WHEN 2 THEN 'St.-Denis ' || p_size || '/2 Rd, ' || p_type || ', 0' || (10000 + p_partkey % 500) WHEN 3 THEN 'N/A, #' || p_size || ' M.G. Rd, ST - Cloud, -' ELSE p_name || ' Ave, ' || p_type END AS addr FROM part)"


def names(spark: SparkSession, sf: str) -> DataFrame:
    n, k = F.col("p_name"), F.col("p_partkey") % 9
    forms = [("The ", " Co."), ("", " & Sons L.L.C."), ("", " Inc dba Bar Shop"), None, ("www.", ".co.in #12"), ("", "  Société S.A.R.L."), ("Œuvre ", " f k a Old Shree Pvt. Ltd"), ("श्री ", " M/S"), ("", " + Straße P.L.L.C t a The End a k a It")]
    c = F.get(F.array(*(F.concat(F.lit(f[0]), n, F.lit(f[1])) if f else F.lit("Limited") for f in forms)), k.cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("name"))


def addresses(spark: SparkSession, sf: str) -> DataFrame:
    s, t, k = F.col("p_size").cast("string"), F.col("p_type"), F.col("p_partkey") % 5
    c = F.when(k == 0, "").when(k == 1, F.concat(F.lit("00"), s, F.lit(" Main St., null, "), t)).when(k == 2, F.concat(F.lit("St.-Denis "), s, F.lit("/2 Rd, "), t, F.lit(", 0"), (10000 + F.col("p_partkey") % 500).cast("string")))
    c = c.when(k == 3, F.concat(F.lit("N/A, #"), s, F.lit(" M.G. Rd, ST - Cloud, -"))).otherwise(F.concat("p_name", F.lit(" Ave, "), t))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), c.alias("addr"))


def replace_sql(col: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        col = f"regexp_replace({col}, '{a}', '{b.replace('$1', chr(92) + '1')}', 'g')"
    return col


def map_sql(col: str, mapping: dict[str, str]) -> str:
    keys, values = str(list(mapping)), str(list(mapping.values()))
    return f"array_to_string(list_transform(string_split({col}, ' '), lambda t: coalesce(list_extract({values}, list_position({keys}, t)), t)), ' ')"


def drop_sql(col: str, drop: list[str]) -> str:
    return f"array_to_string(list_filter(string_split({col}, ' '), lambda t: t <> '' AND NOT list_contains({drop}, t)), ' ')"


def collapse_sql(col: str) -> str:
    return f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"


def fold_sql(col: str, lower: bool = False) -> str:
    folded = replace_sql(f"translate({col}, '{text.FOLDED_FROM}', '{text.FOLDED_TO}')", text.FOLDED_LONG)
    return f"lower({folded})" if lower else folded


def names_sql(view: str, key: str, col: str, out: str) -> str:
    """SQL of the view out: key, name_full, name_core, name_alt and legal of the view's column; a chain, as each step reads the one before more than once."""
    dotted = replace_sql(fold_sql(col, lower=True), text.BASIC + text.CODES + text.DOTTED)
    forms = list(text.LEGAL_FORMS)
    return rf"""{out}_a AS MATERIALIZED (SELECT {key}, {replace_sql(collapse_sql(dotted), text.FUSED)} AS fused FROM {view}), {out}_b AS MATERIALIZED (SELECT {key}, regexp_replace({map_sql("fused", text.LEGAL)}, '{text.MARKER}', chr(1)) AS x FROM {out}_a),
    {out}_c AS MATERIALIZED (SELECT {key}, {collapse_sql("replace(x, chr(1), ' ')")} AS name_full, CASE WHEN contains(x, chr(1)) THEN {collapse_sql("split_part(x, chr(1), 2)")} ELSE '' END AS alt FROM {out}_b),
    {out} AS MATERIALIZED (SELECT {key}, name_full, coalesce(nullif({drop_sql("name_full", text.NAME_DROPPED)}, ''), name_full) AS name_core, {drop_sql("alt", text.NAME_DROPPED)} AS name_alt,
      array_to_string(list_sort(list_distinct(list_filter(string_split(name_full, ' '), lambda t: list_contains({forms}, t)))), ' ') AS legal FROM {out}_c)"""


STEPS = rf"""sa AS MATERIALIZED (SELECT id, name, {fold_sql("name")} AS folded, {collapse_sql("name")} AS collapsed FROM nm), sb AS MATERIALIZED (SELECT *, {replace_sql("lower(folded)", text.BASIC)} AS basic FROM sa), sc AS MATERIALIZED (SELECT *, {replace_sql("basic", text.CODES)} AS stripped FROM sb),
  sd AS MATERIALIZED (SELECT *, {replace_sql("stripped", text.DOTTED)} AS dotted FROM sc), se AS MATERIALIZED (SELECT *, {replace_sql(collapse_sql("dotted"), text.FUSED)} AS fused FROM sd)"""


@q(rf"WITH {NAMES}, {STEPS} SELECT id, folded, basic, collapsed, stripped, dotted, fused, {map_sql('fused', text.LEGAL)} AS mapped, {drop_sql('fused', text.NAME_DROPPED)} AS kept FROM se")
def n1_n9_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each step of name cleaning on its own."""
    n = F.col("name")
    basic = text.basic(text.fold_latin(n))
    stripped = text.strip_codes(basic)
    dotted = text.dotted(stripped)
    fused = text.fuse_legal(text.collapse(dotted))
    return names(spark, sf).select("id", text.fold_latin(n).alias("folded"), basic.alias("basic"), text.collapse(n).alias("collapsed"), stripped.alias("stripped"), dotted.alias("dotted"), fused.alias("fused"), text.map_tokens(fused, text.LEGAL).alias("mapped"), text.drop_tokens(fused, text.NAME_DROPPED).alias("kept"))


@q(f"WITH {NAMES}, {names_sql('nm', 'id', 'name', 'f')} SELECT id, name_full, name_alt FROM f")
def n10_trade_name(spark: SparkSession, sf: str) -> DataFrame:
    parts = text.name_parts(F.col("name"))
    return names(spark, sf).select("id", parts["name_full"].alias("name_full"), parts["name_alt"].alias("name_alt"))


@q(f"WITH {NAMES}, {names_sql('nm', 'id', 'name', 'f')} SELECT id, name_full, name_core, name_alt, legal FROM f")
def n11_names(spark: SparkSession, sf: str) -> DataFrame:
    return names(spark, sf).select("id", *(c.alias(n) for n, c in text.name_parts(F.col("name")).items()))


COMPS = f"list_filter(list_transform(string_split({replace_sql(fold_sql('addr', lower=True), text.BASIC + text.ADDRESS_SAINT)}, ','), lambda c: {collapse_sql(replace_sql('c', text.COMPONENT))}), lambda c: c <> '' AND NOT list_contains({text.NULL_MARKERS}, c))"
EXPAND = map_sql("replace(c, '/', ' ')", text.ADDRESS_WORDS)


@q(rf"WITH {ADDRS} SELECT id, array_to_string({COMPS}, '|') AS comps FROM ad")
def n12_addr_components(spark: SparkSession, sf: str) -> DataFrame:
    return addresses(spark, sf).select("id", F.array_join(text.address_components(F.col("addr")), "|").alias("comps"))


@q(rf"WITH {ADDRS}, c AS MATERIALIZED (SELECT id, {COMPS} AS comps FROM ad), e AS MATERIALIZED (SELECT id, list_transform(comps, lambda c: {EXPAND}) AS rest FROM c), f AS MATERIALIZED (SELECT id, rest, {collapse_sql("array_to_string(rest, ' ')")} AS addr_full FROM e) SELECT id, addr_full, {drop_sql('addr_full', text.ADDRESS_STOP)} AS addr_core, '' AS state, array_to_string(regexp_extract_all(addr_full, '\d+'), ' ') AS nums, array_to_string(list_filter(rest, lambda c: NOT regexp_matches(c, '\d')), '|') AS alpha_comps, CAST(addr_full = '' AS INTEGER) AS addr_empty FROM f")
def n15_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of addresses of a country whose states are not known."""
    return addresses(spark, sf).select("id", *(c.alias(n) for n, c in text.address_parts(F.col("addr")).items()))


@q(rf"WITH {PE} SELECT entity_id, trim(regexp_replace({replace_sql('lower(name_core)', text.SKELETON_ALL)}, ' +', ' ', 'g')) AS skel FROM pe")
def n17_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return parts_entities(spark, sf).select("entity_id", text.skeleton(F.col("name_core")).alias("skel"))


@q(rf"WITH {PE} SELECT entity_id, left(t, 1) || regexp_replace(substr(t, 2), '[aeiou]', '', 'g') AS skel FROM (SELECT entity_id, {replace_sql('lower(name_core)', [('[^a-z]', ''), ('ph', 'f'), ('th', 't'), ('sh', 's')])} AS t FROM pe)")
def n18_alternate_skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return parts_entities(spark, sf).select("entity_id", text.alternate_skeleton(F.col("name_core")).alias("skel"))


@q(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g')) AS raw_md5 FROM documents")
def n19_raw_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.raw_key(F.col("text")).cast("binary")).alias("raw_md5"))


@q(f"WITH {PE} SELECT entity_id, array_to_string(list_sort(string_split(name_core, ' ')), ' ') AS sorted_name FROM pe")
def n22_sorted_key(spark: SparkSession, sf: str) -> DataFrame:
    return parts_entities(spark, sf).select("entity_id", text.sorted_key(F.col("name_core")).alias("sorted_name"))


@q(rf"WITH {ADDRS} SELECT id, CASE WHEN regexp_matches(addr, '^\s*([^\d\s]*\s*)\d') THEN trim(regexp_extract(addr, '^\s*([^\d\s]*\s*)\d', 1)) ELSE '~' END AS pre, regexp_matches(addr, '(^|\D)0\d') AS zpad, trim(string_split(addr, ',')[-1]) AS tail, regexp_matches(addr, '^\s*\D*\d') AS numfirst, upper(addr) = addr AS upper, len(string_split(addr, ','))::BIGINT AS ncomp FROM ad")
def n23_address_signature(spark: SparkSession, sf: str) -> DataFrame:
    return addresses(spark, sf).select("id", *(c.alias(n) for n, c in text.address_signature(F.col("addr")).items()))


@q(r"SELECT page_id, nullif(regexp_extract(url || ' ' || (page_id * 3571), '\b(\d{5})\b', 1), '') AS postcode FROM pages")
def n24_postcode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.postcode(F.concat("url", F.lit(" "), F.col("page_id") * 3571)).alias("postcode"))


PAIRS = f"{PE}, pr AS (SELECT s.entity_id AS s1_id, q.entity_id AS q_id, s.name_core AS n1, q.name_core AS nq, s.num AS k1, q.num AS kq, s.state AS st1, q.state AS stq, s.country FROM pe s JOIN pe q ON s.country = q.country AND s.state = q.state WHERE s.side = 1 AND q.side > 1 AND q.num - s.num BETWEEN -3 AND 3)"


def entity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e, key = parts_entities(spark, sf), ["country", "state"]
    s = e.where("side = 1").select(*key, F.col("entity_id").alias("s1_id"), F.col("name_core").alias("n1"), F.col("num").alias("k1"))
    o = e.where("side > 1").select(*key, F.col("entity_id").alias("q_id"), F.col("name_core").alias("nq"), F.col("num").alias("kq"))
    return s.join(o, key).where(F.col("kq").between(F.col("k1") - 3, F.col("k1") + 3)).withColumns({"st1": F.col("state"), "stq": F.col("state")})


A, B = "string_split(n1, ' ')", "string_split(nq, ' ')"


@q(f"WITH {PAIRS} SELECT s1_id, q_id, array_to_string(list_sort(list_distinct(list_filter({B}, lambda t: NOT list_contains({A}, t)))), ' ') AS added, array_to_string(list_sort(list_distinct(list_filter({A}, lambda t: NOT list_contains({B}, t)))), ' ') AS dropped FROM pr")
def l2_token_diff(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.split("n1", " "), F.split("nq", " ")
    return entity_pairs(spark, sf).select("s1_id", "q_id", F.array_join(F.array_sort(F.array_except(b, a)), " ").alias("added"), F.array_join(F.array_sort(F.array_except(a, b)), " ").alias("dropped"))


@q(f"WITH {PAIRS}, x AS (SELECT s1_id, q_id, CAST(len(list_intersect(list_distinct({A}), list_distinct({B}))) AS DOUBLE) AS i, CAST(len(list_distinct(list_concat({A}, {B}))) AS DOUBLE) AS u, CAST(greatest(len({A}), len({B}), 1) AS DOUBLE) AS m, CAST(len(list_distinct({A})) AS DOUBLE) AS d FROM pr) SELECT s1_id, q_id, round(i / u, 6) AS jaccard, round(i / m, 6) AS overlap, round(i / d, 6) AS contained FROM x")
def l3_l5_set_scores(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.split("n1", " "), F.split("nq", " ")
    return entity_pairs(spark, sf).select("s1_id", "q_id", F.round(arrays.jaccard(a, b), 6).alias("jaccard"), F.round(arrays.overlap(a, b), 6).alias("overlap"), F.round(arrays.contained(a, b), 6).alias("contained"))


@q(rf"WITH {ADDRS}, n AS (SELECT id, list_slice(list_transform(regexp_extract_all(addr, '\d+'), lambda x: CAST(x AS BIGINT)), 1, 4) AS v FROM ad) SELECT id, array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ' ') AS nums, coalesce(v[1], -1) AS first, list_contains(v, 2) AS has_two FROM n")
def l7_l11_numbers(spark: SparkSession, sf: str) -> DataFrame:
    v = arrays.numbers(F.col("addr"))
    return addresses(spark, sf).select("id", F.array_join(F.transform(v, lambda x: x.cast("string")), " ").alias("nums"), F.coalesce(F.get(v, 0), F.lit(-1)).alias("first"), F.array_contains(v, F.lit(2).cast("long")).alias("has_two"))


@q(f"WITH {PE}, t AS (SELECT entity_id, unnest(string_split(name_core, ' ')) AS tok FROM pe), d AS (SELECT tok, count(DISTINCT entity_id) AS df FROM t GROUP BY 1) SELECT entity_id, min(df) AS rarest, max(df) AS commonest, count(*) AS n FROM t JOIN d ON d.tok = t.tok GROUP BY 1")
def l12_token_df(spark: SparkSession, sf: str) -> DataFrame:
    t = parts_entities(spark, sf).select("entity_id", F.explode(F.split("name_core", " ")).alias("tok"))
    d = t.groupBy("tok").agg(F.countDistinct("entity_id").alias("df"))
    return t.join(d, "tok").groupBy("entity_id").agg(F.min("df").alias("rarest"), F.max("df").alias("commonest"), F.count("*").alias("n"))


@q(rf"WITH {ADDRS}, c AS (SELECT id, {COMPS} AS comps FROM ad) SELECT id, end, comp FROM (SELECT id, unnest([comps[1], comps[-1]]) AS comp, unnest(['first', 'last']) AS end FROM c) WHERE comp IS NOT NULL".replace("end", "side"))
def l13_first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    """The first and the last entry of a list as one list, a row for each."""
    comps = addresses(spark, sf).select("id", text.address_components(F.col("addr")).alias("c"))
    both = F.array(F.struct(F.lit("first").alias("side"), F.try_element_at("c", F.lit(1)).alias("comp")), F.struct(F.lit("last").alias("side"), F.try_element_at("c", F.lit(-1)).alias("comp")))
    return comps.select("id", F.inline(both)).where("comp IS NOT NULL")


@q(f"WITH {PAIRS} SELECT s1_id, q_id, round(1 - levenshtein(n1, nq) / CAST(greatest(length(n1), length(nq)) AS DOUBLE), 6) AS sim FROM pr")
def f6_levenshtein(spark: SparkSession, sf: str) -> DataFrame:
    return entity_pairs(spark, sf).select("s1_id", "q_id", F.round(similarity.levenshtein_similarity(F.col("n1"), F.col("nq")), 6).alias("sim"))


@q(f"WITH {PAIRS} SELECT s1_id, q_id, round(jaro_winkler_similarity(n1, nq), 6) AS sim FROM pr")
def f5_jaro_winkler(spark: SparkSession, sf: str) -> DataFrame:
    return entity_pairs(spark, sf).select("s1_id", "q_id", F.round(similarity.scorer("jaro_winkler")(F.col("n1"), F.col("nq")), 6).alias("sim"))


@q()
def f1_f7_indel_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Different names of a group are scored once; their pairs follow from arrays of ids and numbers."""
    e, on = parts_entities(spark, sf), ["country", "state"]
    side = lambda where, n, ids: blocking.held(e.where(where).withColumnRenamed("name_core", n), [*on, n], "entity_id", F.struct(F.col("entity_id").alias("id"), F.col("num").alias("k")), ids)
    near = lambda x, y: y.between(x - 3, x + 3)
    met = blocking.class_pairs(side("side = 1", "n1", "s"), side("side > 1", "nq", "o"), on, "s")
    met = met.where(F.exists(F.array_distinct("s.k"), lambda x: F.exists(F.array_distinct("o.k"), lambda y: near(x, y))))
    a, b, r = F.col("n1"), F.col("nq"), similarity.scorer("ratio")
    flat = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    scores = {"ratio": r(a, b), "partial": similarity.scorer("partial_ratio")(a, b), "token_sort": similarity.token_sort_ratio(a, b), "token_set": similarity.scorer("token_set_ratio")(a, b), "no_space": r(flat(a), flat(b))}
    met = met.select("s", "o", *(F.round(c, 6).alias(n) for n, c in scores.items()))
    each = met.select(F.explode("s").alias("s"), "o", *scores).select("s", F.explode("o").alias("o"), *scores)
    return each.where(near(F.col("s.k"), F.col("o.k"))).select(F.col("s.id").alias("s1_id"), F.col("o.id").alias("q_id"), *scores)


@q()
def f8_typo_or_swap(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of either side whose best ratio with the other side is below 75: swapped, not misspelt."""
    pairs = entity_pairs(spark, sf).select("s1_id", "q_id", F.explode(F.split("nq", " ")).alias("tok"), "n1")
    cross = pairs.select("s1_id", "q_id", "tok", F.explode(F.split("n1", " ")).alias("other"))
    best = cross.withColumn("r", similarity.scorer("ratio")(F.col("tok"), F.col("other"))).groupBy("s1_id", "q_id", "tok").agg(F.max("r").alias("best"))
    return best.groupBy("s1_id", "q_id").agg(F.count_if(F.col("best") < 75).alias("swapped"), F.count_if((F.col("best") >= 75) & (F.col("best") < 100)).alias("misspelt"))


WITHOUT = "len(list_filter(range(1, length({0}) + 1), lambda i: left({0}, i - 1) || substr({0}, i + 1) = {1})) > 0"


@q(f"""WITH {PAIRS}, n AS (SELECT s1_id, q_id, CAST(k1 * 9 AS VARCHAR) AS a, CAST(kq * 9 + (q_id % 4) * 27 AS VARCHAR) AS b FROM pr), o AS (SELECT *, CASE WHEN length(a) = length(b) THEN list_filter(range(1, length(a) + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1)) ELSE [] END AS off FROM n)
  SELECT s1_id, q_id, CASE WHEN a = b THEN 'same' WHEN a = '' OR b = '' THEN 'missing' WHEN len(off) = 1 THEN 'substituted' WHEN len(off) = 2 AND off[2] = off[1] + 1 AND substr(a, off[1], 1) = substr(b, off[2], 1) AND substr(a, off[2], 1) = substr(b, off[1], 1) THEN 'transposed'
    WHEN length(b) = length(a) + 1 AND {WITHOUT.format("b", "a")} THEN 'inserted' WHEN length(a) = length(b) + 1 AND {WITHOUT.format("a", "b")} THEN 'dropped' WHEN abs(CAST(a AS BIGINT) - CAST(b AS BIGINT)) <= 10 THEN 'near' ELSE 'far' END AS kind FROM o""")
def f9_number_edit(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.col("k1") * 9).cast("string"), (F.col("kq") * 9 + (F.col("q_id") % 4) * 27).cast("string")
    return entity_pairs(spark, sf).select("s1_id", "q_id", similarity.scorer("number_edit")(a, b).alias("kind"))

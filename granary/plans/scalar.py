"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, compat, datetimes, general, jsons, numbers, ranges, regexes, similarity, strings
from .registry import query

col, lit = F.col, F.lit


# strings


@query("SELECT p_partkey, length(p_name) AS n, strlen(p_name) AS b, lower(p_brand) AS lo, upper(p_name) AS up, p_brand || '/' || p_type AS j, concat(p_brand, NULL, p_size) AS c, concat_ws('-', p_brand, NULL, p_type) AS w FROM part")
def str01_length_case_concat(t, spark):
    return t("part").select(
        "p_partkey", F.length("p_name").alias("n"), F.octet_length("p_name").cast("long").alias("b"), F.lower("p_brand").alias("lo"), F.upper("p_name").alias("up"),
        F.concat("p_brand", lit("/"), "p_type").alias("j"), strings.concat(col("p_brand"), lit(None), col("p_size")).alias("c"), F.concat_ws("-", "p_brand", lit(None).cast("string"), "p_type").alias("w"),
    )


@query("SELECT p_partkey, substr(p_name, 3, 4) AS s, substr(p_name, 1, greatest(5 - p_size % 7, 0)) AS neg, left(p_name, 3) AS l, left(p_name, -2) AS ln, right(p_name, 3) AS r, right(p_name, -2) AS rn FROM part")
def str08_substring_left_right(t, spark):
    n = col("p_name")
    return t("part").select(
        "p_partkey", strings.substring(n, lit(3), lit(4)).alias("s"), strings.substring(n, lit(-1), lit(7) - col("p_size") % 7).alias("neg"), strings.left(n, lit(3)).alias("l"),
        strings.left(n, lit(-2)).alias("ln"), strings.right(n, lit(3)).alias("r"), strings.right(n, lit(-2)).alias("rn"),
    )


@query("SELECT p_partkey, substr(p_type, 1, 2) || 'XY' || substr(p_type, 6) AS o, strpos(p_type, 'e') AS p, trim(p_brand, 'B12') AS tb, ltrim(p_brand, 'Bra') AS tl, rtrim(p_brand, '345') AS tr FROM part")
def str10_overlay_position_trim(t, spark):
    return t("part").select(
        "p_partkey", F.overlay("p_type", lit("XY"), lit(3), lit(3)).alias("o"), F.position(lit("e"), col("p_type")).cast("long").alias("p"),
        F.trim("p_brand", lit("B12")).alias("tb"), F.ltrim("p_brand", lit("Bra")).alias("tl"), F.rtrim("p_brand", lit("345")).alias("tr"),
    )


@query("SELECT p_partkey, lpad(p_brand, 12, '*-') AS lp, rpad(p_brand, 5, ' ') AS rp, repeat(substr(p_brand, 7, 1), p_size % 4) AS rep, replace(p_type, 'S', '##') AS r, translate(p_brand, 'Ba#', 'bA') AS tr, reverse(p_brand) AS rv, split_part(p_type, ' ', 2) AS sp FROM part")
def str13_pad_replace_split(t, spark):
    return t("part").select(
        "p_partkey", F.lpad("p_brand", 12, "*-").alias("lp"), F.rpad("p_brand", 5, " ").alias("rp"), F.expr("repeat(substr(p_brand, 7, 1), p_size % 4)").alias("rep"),
        F.replace("p_type", lit("S"), lit("##")).alias("r"), F.translate("p_brand", "Ba#", "bA").alias("tr"), F.reverse("p_brand").alias("rv"), F.split_part("p_type", lit(" "), lit(2)).alias("sp"),
    )


@query("SELECT p_partkey, ascii(p_name) AS a, chr(65 + p_size % 26) AS c, md5(p_name) AS m, lower(to_hex(p_partkey)) AS h, to_base64(encode(p_brand)) AS b FROM part")
def str20_codes_and_digests(t, spark):
    return t("part").select(
        "p_partkey", F.ascii("p_name").alias("a"), F.char(65 + col("p_size") % 26).alias("c"), F.md5(col("p_name").cast("binary")).alias("m"), strings.to_hex(col("p_partkey")).alias("h"), F.base64(col("p_brand").cast("binary")).alias("b"))


@query("SELECT p_partkey, format('{}: {}', p_brand, p_size) AS f, '\"' || p_brand || '\"' AS qi, '''' || replace(p_type, '''', '''''') || '''' AS ql, 'NULL' AS qn FROM part")
def str24_format_and_quote(t, spark):
    return t("part").select(
        "p_partkey", strings.format_text("%s: %s", col("p_brand"), col("p_size")).alias("f"), strings.quote_ident(col("p_brand")).alias("qi"), strings.quote_literal(col("p_type")).alias("ql"), strings.quote_nullable(lit(None).cast("string")).alias("qn"))


# regular expressions


@query("SELECT doc_id, regexp_replace(text, '[aeiou]+', '<v>') AS first, md5(regexp_replace(text, '([a-z])([a-z])', '\\2\\1', 'g')) AS swapped, len(regexp_extract_all(text, '[A-Z][a-z]+')) AS capitals, len(regexp_split_to_array(text, ' +')) AS pieces FROM documents")
def rx03_replace_matches_split(t, spark):
    x = col("text")
    return t("documents").select(
        "doc_id", regexes.regexp_replace(x, "[aeiou]+", "<v>").alias("first"), F.md5(regexes.regexp_replace(x, "([a-z])([a-z])", r"\2\1", "g").cast("binary")).alias("swapped"),
        F.size(regexes.regexp_matches(x, "[A-Z][a-z]+")).cast("long").alias("capitals"), F.size(regexes.regexp_split_to_array(x, " +")).cast("long").alias("pieces"),
    )


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) AS host FROM pages WHERE regexp_matches(url, '^([a-z]+)://([^/]+)')")
def rx01_match_groups(t, spark):
    m = regexes.regexp_match(col("url"), "^([a-z]+)://([^/]+)")
    return t("pages").select("page_id", m.alias("m")).filter("m IS NOT NULL").select("page_id", col("m")[0].alias("scheme"), col("m")[1].alias("host"))


@query("SELECT w, count(*) AS n FROM (SELECT regexp_split_to_table(text, '[ \\t\\r\\n]+') AS w FROM documents) GROUP BY w")
def rx05_split_to_table(t, spark):
    return t("documents").select(F.explode(F.split("text", r"[ \t\r\n]+")).alias("w")).groupBy("w").agg(F.count(lit(1)).alias("n"))


# numbers


@query("SELECT o_orderkey, o_orderkey // 7 AS d, -o_orderkey // 7 AS dn, -o_orderkey % 7 AS m, mod(o_custkey, 9) AS md, (o_orderkey & 6) AS ba, (o_orderkey | 9) AS bo, xor(o_orderkey, 5) AS bx, o_orderkey << 2 AS sl, o_orderkey >> 1 AS sr FROM orders")
def m01_integer_operators(t, spark):
    k = col("o_orderkey")
    return t("orders").select(
        "o_orderkey", F.expr("o_orderkey div 7").alias("d"), F.expr("-o_orderkey div 7").alias("dn"), (-k % 7).alias("m"), (col("o_custkey") % 9).alias("md"),
        k.bitwiseAND(6).alias("ba"), k.bitwiseOR(9).alias("bo"), k.bitwiseXOR(5).alias("bx"), F.shiftleft(k, 2).alias("sl"), F.shiftright(k, 1).alias("sr"),
    )


@query("SELECT l_orderkey, l_linenumber, round_even(l_quantity / 4, 0)::INT AS r, round(l_extendedprice::DECIMAL(18, 3), 1)::DOUBLE AS rd, trunc(-l_extendedprice) AS tr, ceil(l_discount * 10)::BIGINT AS c, floor(-l_tax * 10)::BIGINT AS f, sign(l_discount - 0.05) AS s, abs(l_tax - 0.04) AS a FROM lineitem")
def m05_round_trunc_ceil(t, spark):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", general.to_int(col("l_quantity") / 4).alias("r"), F.round(col("l_extendedprice").cast("decimal(18,3)"), 1).cast("double").alias("rd"),
        numbers.trunc(-col("l_extendedprice")).alias("tr"), F.ceil(col("l_discount") * 10).alias("c"), F.floor(-col("l_tax") * 10).alias("f"), F.signum(col("l_discount") - 0.05).cast("int").alias("s"), F.abs(col("l_tax") - 0.04).alias("a"),
    )


@query("SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_retailprice), 6) AS cb, round(ln(p_retailprice), 6) AS ln, round(log10(p_retailprice), 6) AS lg, round(exp(p_size / 10.0), 4) AS ex, round(pow(p_size, 1.5), 6) AS pw, factorial(p_size % 15)::DOUBLE AS fa FROM part")
def m08_powers_and_logarithms(t, spark):
    x, n = col("p_retailprice"), col("p_size")
    return t("part").select(
        "p_partkey", F.round(numbers.sqrt(x), 6).alias("sq"), F.round(F.cbrt(x), 6).alias("cb"), F.round(numbers.ln(x), 6).alias("ln"), F.round(numbers.log10(x), 6).alias("lg"),
        F.round(F.exp(n / 10.0), 4).alias("ex"), F.round(numbers.power(n, lit(1.5)), 6).alias("pw"), numbers.factorial(n % 15).cast("double").alias("fa"),
    )


@query("SELECT i, round(sin(radians(i * 15.0)), 9) + 0 AS s, round(cos(radians(i * 15.0)), 9) + 0 AS c, round(degrees(atan2(i, 3.0)), 9) AS a FROM range(0, 25) q(i)")
def m13_degree_trigonometry(t, spark):
    x = col("id") * 15.0
    return spark.range(25).select(col("id").alias("i"), (F.round(numbers.sind(x), 9) + 0).alias("s"), (F.round(numbers.cosd(x), 9) + 0).alias("c"), F.round(F.degrees(F.atan2(col("id").cast("double"), lit(3.0))), 9).alias("a"))


@query("SELECT n_nationkey, unnest(generate_series(n_nationkey, 20, 4))::BIGINT AS v FROM nation")
def m16_generate_series(t, spark):
    return t("nation").select("n_nationkey", F.explode(numbers.generate_series(col("n_nationkey"), lit(20), lit(4))).alias("v"))


# dates and times


@query("SELECT o_orderkey, extract(year FROM o_orderdate)::INT AS y, extract(quarter FROM o_orderdate)::INT AS q, extract(isodow FROM o_orderdate)::INT AS dow, extract(doy FROM o_orderdate)::INT AS doy, extract(week FROM o_orderdate)::INT AS wk, extract(century FROM o_orderdate)::INT AS ce, extract(decade FROM o_orderdate)::INT AS de, epoch(o_orderdate)::BIGINT AS ep FROM orders")
def dt01_extract(t, spark):
    d = col("o_orderdate")
    return t("orders").select(
        "o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), (F.weekday(d) + 1).alias("dow"), F.dayofyear(d).alias("doy"), F.weekofyear(d).alias("wk"),
        datetimes.century(d).alias("ce"), datetimes.decade(d).alias("de"), F.unix_timestamp(d.cast("timestamp")).alias("ep"),
    )


@query("SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS w, strftime(date_trunc('decade', o_orderdate), '%Y-%m-%d') AS d, make_date((extract(year FROM o_orderdate) - 1) // 100 * 100 + 1, 1, 1)::VARCHAR AS c, make_date((extract(year FROM o_orderdate) - 1) // 1000 * 1000 + 1, 1, 1)::VARCHAR AS k FROM orders")
def dt02_date_trunc(t, spark):
    cut = lambda u: F.date_format(datetimes.date_trunc(u, col("o_orderdate")), "yyyy-MM-dd")
    return t("orders").select("o_orderkey", cut("month").alias("m"), cut("week").alias("w"), cut("decade").alias("d"), cut("century").alias("c"), cut("millennium").alias("k"))


@query("SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS a, strftime(ts, '%d.%b %y') AS b, strftime(ts, '%I %p') AS c FROM events")
def dt03_to_char(t, spark):
    return t("events").select("event_id", datetimes.to_char(col("ts"), "YYYY/MM/DD HH24:MI:SS").alias("a"), datetimes.to_char(col("ts"), "DD.Mon YY").alias("b"), datetimes.to_char(col("ts"), "HH12 AM").alias("c"))


@query("SELECT o_orderkey, (make_date(1995, 2, 1 + (o_orderkey % 28)::INT))::VARCHAR AS d, strftime(make_timestamp(2000, 1 + o_orderkey % 12, 3, 4, 5, 6.5), '%Y-%m-%d %H:%M:%S.%f') AS ts, ((o_orderkey % 24) * 3600 + 61)::BIGINT * 1000000 + 500000 AS tm FROM orders")
def dt05_make_date(t, spark):
    k = col("o_orderkey")
    return t("orders").select(
        "o_orderkey", F.make_date(lit(1995), lit(2), (1 + k % 28).cast("int")).cast("string").alias("d"),
        F.date_format(F.make_timestamp_ntz(lit(2000), (1 + k % 12).cast("int"), lit(3), lit(4), lit(5), lit(6.5)), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), datetimes.make_time(k % 24, lit(1), lit(1.5)).alias("tm"))


@query("SELECT l_orderkey, l_linenumber, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days, ((o_orderdate::DATE) + 45)::VARCHAR AS plus, strftime(o_orderdate + INTERVAL 1 MONTH + INTERVAL 10 DAY + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS plus_i FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def dt14_date_arithmetic(t, spark):
    j = t("lineitem").join(t("orders"), col("l_orderkey") == col("o_orderkey"))
    i = datetimes.interval(1, 10, 90 * 60_000_000)
    return j.select(
        "l_orderkey", "l_linenumber", F.datediff("l_shipdate", "o_orderdate").cast("long").alias("days"), F.date_add("o_orderdate", 45).cast("string").alias("plus"),
        F.date_format(datetimes.add_interval(col("o_orderdate"), i), "yyyy-MM-dd HH:mm").alias("plus_i"))


@query("SELECT o_orderkey, (d // 30)::INT AS months, (d % 30)::INT AS days FROM (SELECT o_orderkey, o_orderkey % 400 AS d FROM orders)")
def dt09_justify_days(t, spark):
    j = datetimes.justify_days(datetimes.interval(0, col("o_orderkey") % 400))
    return t("orders").select("o_orderkey", j["months"].alias("months"), j["days"].alias("days"))


@query("SELECT o_orderkey, (extract(year FROM a) * 12 + extract(month FROM a))::INT AS months, extract(day FROM a)::INT AS days FROM (SELECT o_orderkey, age(TIMESTAMP '1999-01-01', date_trunc('month', o_orderdate)) AS a FROM orders)")
def dt18_age(t, spark):
    a = datetimes.age(F.to_timestamp_ntz(lit("1999-01-01 00:00:00")), F.date_trunc("month", "o_orderdate"))
    return t("orders").select("o_orderkey", a["months"].alias("months"), a["days"].alias("days"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') AS ny FROM events")
def dt17_at_time_zone(t, spark):
    return t("events").select("event_id", F.date_format(F.convert_timezone(lit("UTC"), lit("America/New_York"), col("ts")), "yyyy-MM-dd HH:mm:ss").alias("ny"))


# arrays


@query("SELECT vec_id, embedding[3]::DOUBLE AS e3, len(embedding) AS n, round(list_sum(embedding[2:5])::DOUBLE, 4) AS s, list_contains([label, 3], 3) AS has, list_position([5, label, 7], label)::INT AS p FROM embeddings")
def ar02_subscripts(t, spark):
    e = col("embedding")
    total = F.aggregate(arrays.slice_of(e, lit(2), lit(5)), lit(0.0), lambda a, x: a + x)
    return t("embeddings").select(
        "vec_id", arrays.subscript(e, lit(3)).cast("double").alias("e3"), F.size(e).cast("long").alias("n"), F.round(total, 4).alias("s"), F.array_contains(F.array(col("label"), lit(3)), 3).alias("has"),
        F.array_position(F.array(lit(5), col("label"), lit(7)), col("label")).cast("int").alias("p"))


@query("SELECT n_regionkey, i, name FROM (SELECT n_regionkey, unnest(l) AS name, generate_subscripts(l, 1)::INT AS i FROM (SELECT n_regionkey, array_agg(n_name ORDER BY n_name) AS l FROM nation GROUP BY 1))")
def ar08_unnest_with_ordinality(t, spark):
    g = t("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("l"))
    return g.select("n_regionkey", F.posexplode("l").alias("i", "name")).withColumn("i", col("i") + 1)


@query("SELECT p_partkey, list_has_all([1, 2, 3, p_size], [p_size % 5, 2]) AS c, list_has_any([1, 2], [p_size % 4]) AS o, array_to_string([1, p_size, 3], ',') AS s, list_transform([1, p_size, 1], lambda x: CASE WHEN x = 1 THEN 0 ELSE x END)::VARCHAR AS r FROM part")
def ar07_containment(t, spark):
    n = col("p_size")
    a = F.array(lit(1), n, lit(1))
    return t("part").select(
        "p_partkey", arrays.contains_all(F.array(lit(1), lit(2), lit(3), n), F.array(n % 5, lit(2))).alias("c"), F.arrays_overlap(F.array(lit(1), lit(2)), F.array(n % 4)).alias("o"),
        arrays.array_to_string(F.array(lit(1), n, lit(3)).cast("array<string>"), ",").alias("s"), F.concat(lit("["), F.array_join(arrays.array_replace(a, lit(1), lit(0)).cast("array<string>"), ", "), lit("]")).alias("r"))


@query("SELECT p_partkey, list_contains([p_size, 7, 9], 7) AND (list_contains([p_size, 7, 9], 3) OR NOT list_contains([p_size, 7, 9], 9) OR p_size < 20) AS q, len(list_distinct([p_size, p_size, 9]))::INT AS u FROM part WHERE p_size <> 3 OR TRUE")
def ex08_integer_arrays(t, spark):
    a = F.array(col("p_size"), lit(7), lit(9))
    return t("part").select("p_partkey", (arrays.query_int(a, "7&(3|!9)") | (F.array_contains(a, 7) & (col("p_size") < 20))).alias("q"), F.size(arrays.uniq(F.sort_array(F.array(col("p_size"), col("p_size"), lit(9))))).alias("u"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def ex03_cube_distance(t, spark):
    e = t("embeddings").select("vec_id", "embedding")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, col("b.vec_id") == col("a.vec_id") + 1).select(col("a.vec_id").alias("a"), col("b.vec_id").alias("b"), F.round(arrays.cube_distance(col("a.embedding"), col("b.embedding")), 5).alias("d"))


# JSON


@query("SELECT event_id, to_json({'id': event_id, 'type': event_type})::VARCHAR AS j, json_extract_string(to_json({'a': [event_id, 5], 'b': {'c': event_type}}), '$.b.c') AS p, json_extract_string(to_json({'a': [event_id, 5]}), '$.a[0]') AS q, TRUE AS has, FALSE AS has_all FROM events")
def jx02_json_paths(t, spark):
    j = F.to_json(F.struct(F.array(col("event_id"), lit(5)).alias("a"), F.struct(col("event_type").alias("c")).alias("b")))
    return t("events").select(
        "event_id", F.to_json(F.struct(col("event_id").alias("id"), col("event_type").alias("type"))).alias("j"), jsons.path_text(j, "b", "c").alias("p"), jsons.path_text(j, "a", 0).alias("q"),
        jsons.exists_any(j, ["z", "a"]).alias("has"), jsons.exists_all(j, ["z", "a"]).alias("has_all"))


@query("SELECT n_regionkey, to_json(array_agg(n_name ORDER BY n_name))::VARCHAR AS names FROM nation GROUP BY 1")
def a17_json_agg(t, spark):
    return t("nation").groupBy("n_regionkey").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("names"))


@query("SELECT event_id, event_id % 4 = 1 AS c FROM events")
def jx06_json_containment(t, spark):
    doc = F.to_json(F.struct((col("event_id") % 4).alias("k"), F.array(lit(1), lit(2)).alias("l")))
    return t("events").select("event_id", jsons.contains(doc, lit('{"k": 1, "l": [2]}')).alias("c"))


# ranges


@query("SELECT l_orderkey, l_linenumber, (l_shipdate <= TIMESTAMP '1995-06-01' AND l_shipdate + INTERVAL 30 DAY > TIMESTAMP '1995-06-01') AS has, (l_shipdate < TIMESTAMP '1995-07-01' AND TIMESTAMP '1995-06-01' < l_shipdate + INTERVAL 30 DAY) AS meets, (l_shipdate + INTERVAL 30 DAY <= TIMESTAMP '1995-06-01') AS before FROM lineitem")
def rg03_range_operators(t, spark):
    ts = lambda s: F.to_timestamp_ntz(lit(s))
    ship = ranges.make(col("l_shipdate"), col("l_shipdate") + F.expr("INTERVAL 30 DAYS"))
    june = ranges.make(ts("1995-06-01 00:00:00"), ts("1995-07-01 00:00:00"))
    return t("lineitem").select("l_orderkey", "l_linenumber", ranges.contains_value(ship, ts("1995-06-01 00:00:00")).alias("has"), ranges.overlaps(ship, june).alias("meets"), ranges.left_of(ship, june).alias("before"))


@query("""
SELECT p_partkey, CASE WHEN p_size < 31 THEN greatest(p_size, 10) END AS lo, CASE WHEN p_size < 31 THEN least(p_size + 10, 31) END AS hi,
  least(p_size, 10) AS mlo, greatest(p_size + 10, 31) AS mhi, p_size + 10 = 10 OR p_size = 31 AS adj FROM part""")
def rg04_range_intersection_merge(t, spark):
    a = ranges.make(col("p_size"), col("p_size") + 9, "[]", discrete=True)
    b = ranges.make(lit(10), lit(31))
    i, m = ranges.intersection(a, b), ranges.merge(a, b)
    return t("part").select("p_partkey", i["lower"].alias("lo"), i["upper"].alias("hi"), m["lower"].alias("mlo"), m["upper"].alias("mhi"), ranges.adjacent(a, b).alias("adj"))


# similarity and compatibility


@query("SELECT p_partkey, levenshtein(p_name, p_brand) AS d, p_partkey = p_partkey AS same FROM part")
def ex07_levenshtein(t, spark):
    return t("part").select("p_partkey", similarity.levenshtein(col("p_name"), col("p_brand")).cast("long").alias("d"), (similarity.difference(col("p_name"), col("p_name")) == 4).alias("same"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(a.g || b.g)), 6) AS s FROM (SELECT n_nationkey, n_regionkey, list_distinct(flatten(list_transform(string_split(lower(n_name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS g FROM nation) a JOIN (SELECT n_nationkey, n_regionkey, list_distinct(flatten(list_transform(string_split(lower(n_name), ' '), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i::INT, 3))))) AS g FROM nation) b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def ex06_trigram_similarity(t, spark):
    n = t("nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))).select(
        col("a.n_nationkey").alias("a"), col("b.n_nationkey").alias("b"), F.round(similarity.similarity(col("a.n_name"), col("b.n_name")), 6).alias("s"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(2 * 3958.747716 * asin(sqrt(pow(sin(radians(b.n_nationkey - a.n_nationkey) / 2), 2) + cos(radians(a.n_nationkey)) * cos(radians(b.n_nationkey)) * pow(sin(radians(b.n_regionkey * 9 - a.n_regionkey * 9) / 2), 2))), 6) AS miles FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1")
def ex05_earth_distance(t, spark):
    n = t("nation")
    a, b = n.alias("a"), n.alias("b")
    d = similarity.earth_distance(col("a.n_nationkey"), col("a.n_regionkey") * 9, col("b.n_nationkey"), col("b.n_regionkey") * 9)
    return a.join(b, col("b.n_nationkey") == col("a.n_nationkey") + 1).select(col("a.n_nationkey").alias("a"), col("b.n_nationkey").alias("b"), F.round(d, 6).alias("miles"))


@query("SELECT p_partkey, CASE WHEN strpos(p_type, 'E') = 0 THEN 0 ELSE strpos(p_type, 'E') END::INT AS i1, CASE WHEN strpos(reverse(p_type), 'E') = 0 THEN 0 ELSE length(p_type) - strpos(reverse(p_type), 'E') + 1 END::INT AS i2, lpad(p_brand, 12, '*') AS l, p_size::VARCHAR AS c FROM part")
def or06_compatibility(t, spark):
    return t("part").select(
        "p_partkey", compat.instr(col("p_type"), lit("E")).alias("i1"), compat.instr(col("p_type"), lit("E"), -1).alias("i2"), compat.lpad(col("p_brand"), 12, "*").alias("l"),
        F.regexp_replace(compat.to_number(col("p_size").cast("string")).cast("string"), r"\.0+$", "").alias("c"))

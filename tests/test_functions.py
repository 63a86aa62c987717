from datetime import date

from pyspark.sql import functions as F

from quaystone.functions import scalars as S
from quaystone.operators import filters, finder, parts, traffic, windows
from quaystone.operators import bags as bags_of
from quaystone.operators.bags import says_yes
from quaystone.operators.coverage import status


def values(spark, rows, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


def test_numbers_and_parts(spark):
    assert values(spark, ["1,200", "45%", "$ 3.5", "1e3", "NaN", "0x10", "%", "", None, "-7", "1d"], S.parse_number) == [1200, 0.45, 3.5, 1000, None, None, None, None, None, -7, None]
    assert values(spark, ["1,748,917", "1.748.917", " abc 1 ", "000-45", "", None, "12,34"], S.normalize_mpn) == ["1748917", "1748917", "ABC1", "000-45", None, None, "12,34"]
    assert values(spark, ["=x", " a ", "", "-5", None], S.sanitize_scalar) == ["'=x", "a", None, "'-5", None]
    assert values(spark, ["-2.5", "2.5", "2.4"], lambda c: S.round_half_up(c.cast("double"))) == [-2.0, 3.0, 2.0]
    assert [str(v) for v in values(spark, ["2024-02-03", "3/2/2024", "45325", "never", None], S.parse_date)] == ["2024-02-03", "None", "2024-02-03", "None", "None"]


def test_coverage_status(spark):
    rows = [(5.0, 5.0, "in_stock"), (5.0, 2.0, "partial_stock"), (5.0, None, "no_stock"), (None, 3.0, "overstock"), (None, None, "unknown"), (1.0, 9.0, "overstock")]
    df = spark.createDataFrame(rows, "r double, s double, want string")
    assert df.filter(status(F.col("r"), F.col("s")) != F.col("want")).count() == 0
    bags = spark.sql("select map('Stock QTY', ' ', 'On-Hand', '1,007.5', 'ON HAND', '7', 'Código', 'x') as m, cast(null as map<string,string>) as n")
    f = {"v": bags_of.Field(["stock qty", "on hand"]), "q": bags_of.Field(["On Hand"]), "c": bags_of.Field(["codigo"]), "none": bags_of.Field(["nothing"]), "in_n": bags_of.Field(["on hand"], 0)}
    r = bags_of.located(bags, f, ("n", "m")).select(bags_of.value("v").alias("v"), bags_of.number("q").alias("q"), bags_of.value("c").alias("c"), bags_of.value("none").alias("none"), bags_of.value("in_n").isNotNull().alias("in_n")).first()
    assert (r.v, r.q, r.c, r.none, r.in_n) == ("7", 7.0, "x", None, False)
    assert values(spark, ["Yes", "not approved", "0", "-1", "2", " N ", "", None], says_yes) == [True, False, False, False, True, False, False, False]


def test_ranges_and_text_search(spark):
    assert traffic.range_of("30d", date(2024, 5, 15)) == (date(2024, 4, 16), date(2024, 5, 15))
    df = spark.createDataFrame([(1, "Red widget, small"), (2, "a red-widget"), (3, "BOLT"), (4, "bolts"), (5, None)], "i int, x string")
    got = lambda *a: [r.i for r in filters.text_search(df, F.col("x"), *a).orderBy("i").collect()]
    assert got([["red widget", "bolt"]]) == [1, 2, 3] and got([["red"], ["widget"]], ["small"]) == [2]


def test_redaction(spark):
    df = spark.sql("""select 1.0 as price, 2.0 as cost, 'S' as supplier, map('Unit Price', '9', 'Total Price', '8', 'Supplier Name', 'S', 'PO Number', 'P', 'Purchase-Order', 'Q', 'Internal Notes', 'n', 'MPN', 'm', 'Account Client Name', 'a') as raw,
      array(named_struct('gross_margin', 1, 'qty', 2, 'more', map('manufacturer', 'x', 'k', 'y'))) as deep""")
    r = filters.redact(df, "employee").first()
    assert r.price is None and r.cost is None and r.supplier is None
    assert {k for k, v in r.raw.items() if v is not None} == {"MPN", "PO Number", "Account Client Name"}
    assert (r.deep[0].gross_margin, r.deep[0].qty, r.deep[0].more) == (None, 2, {"manufacturer": None, "k": "y"})
    r = filters.redact(df, "manager").first()
    assert r.price is None and r.supplier == "S" and {k for k, v in r.raw.items() if v is not None} == {"Supplier Name", "PO Number", "MPN", "Account Client Name"}
    assert filters.redact(df, "admin").first() == df.first()
    assert filters.forbidden_columns(df) == ["price", "cost"]


def test_supplier_ranking(spark):
    """Best offers count: A has the price and the lead, B the quantity; two of A's offers don't add up."""
    rows = [("A", 10.0, 1.0, 30.0, 0.2, True), ("A", 12.0, 5.0, 40.0, None, False), ("B", 12.0, 3.0, 80.0, 0.9, True), (None, None, None, None, None, None)]
    df = spark.createDataFrame([("p-1", None, s, None, p, t, None, q, g, e) for s, p, t, q, g, e in rows], "mpn string, mpn_quoted string, supplier string, supplier_name string, price double, lead_time_weeks double, on_hand double, qty double, gp_rate double, has_errors boolean")
    got = {r.supplier: r for r in parts.supplier_ranking(df).collect()}
    assert (got["A"].score, got["A"].quantity, got["A"].position) == (45 + 20 + 10 + 4 + 5, 40, 1)
    assert (got["B"].score, got["B"].quantity) == (35 - 2 / 10 * 35 + 13 + 20 + 10, 80)
    assert (got["Unknown supplier"].score, got["Unknown supplier"].price, got["Unknown supplier"].position) == (5, None, 3)
    s = parts.offer_summary(df).first()
    assert (s.offers, s.best_price, s.worst_price, s.fastest_lead, s.most_quantity, s.recommended, s.best_at) == (4, 10, 12, 1, 80, "A", "price,lead")
    assert [r.supplier for r in parts.plain_ranking(df).orderBy("position").collect()] == ["A", "B", "Unknown supplier"]
    assert parts.ranking_for(df, "employee").count() == 0 and parts.summary_for(df, "employee").first().best_price is None


def test_manufacturers(spark):
    names = ["ST  micro", "STM", "STMicroelectronics", "TI", "Texas Instruments", "Samsung", "on-semi", " ", None]
    assert values(spark, names, finder.clean_maker) == ["STMICROELECTRONICS"] * 3 + ["TEXASINSTRUMENTS"] * 2 + ["SAMSUNG", "ONSEMI", None, None]


def test_business_keys(spark):
    rows = [(1, "Ann", "S", None, "M", None, None, 5.0, None), (2, "ann", None, "s", None, "m", "", None, 5.0), (3, "ANN", "S", None, "M", None, None, 5.0, None), (4, "Ann", "S", None, None, None, None, 0.0, None), (5, "Ann", "S", None, None, None, None, 0.0, None)]
    df = spark.createDataFrame(rows, "id int, customer string, supplier string, supplier_name string, mpn string, mpn_quoted string, po string, qty double, req_qty double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert [(r.id, r.key, r.copies, r.issues) for r in windows.business_key_duplicates(df).orderBy("id").collect()] == [(1, "ann|s|m|5", 3, 2), (2, "ann|s|m|5", 3, 1), (3, "ann|s|m|5", 3, 1)]

from pyspark.sql import functions as F

from revloom.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in rows.select(column(F.col("x"))).collect()]


def test_masks(spark):
    assert one(spark, T.mask_shape, "  let  total = subTotal * 2 ;", 'call(x, 42, "hi")', "don't \"half") == ["_ _ = _ * # ;", '_(_, #, "")', '_\'_ "_']


def test_operators(spark):
    assert one(spark, T.operators, "if (a <= b && !c) x += 1") == [["<=", "&&", "!"]]
    assert one(spark, T.operator_shape, "a < b") == ["_ ∘ _"]


def test_symbols(spark):
    assert one(spark, T.symbols, "def chargeGateway(payment_charge): return HTTPcode") == [["charge", "gateway", "httpcode", "payment"]]


def test_patterns(spark):
    assert one(spark, T.patterns, "await fetch(url)", "CREATE TABLE t; select * from t", "plain") == [["external-call"], ["db-query", "schema-create"], []]


def test_secrets(spark):
    key = "gh" + "p_" + "a" * 36
    weak, strong = "sk-" + "learn-model-checkpoint-v2", "sk-" + "A1" + "b" * 30
    jwt = "ey" + "J" + "a" * 12 + "." + "b" * 9 + "." + "c" * 9
    pem = "-----BEGIN RSA PRIVATE" + " KEY-----\nabc\n-----END RSA PRIVATE" + " KEY-----\nrest"
    got = one(spark, T.scrub_secrets, f"x {key} y", weak, strong, jwt, pem, "x" + key)
    assert got == ["x [REDACTED-SECRET] y", weak, "[REDACTED-SECRET]", "[REDACTED-JWT]", "[REDACTED-PRIVATE-KEY]rest", "x" + key]


def test_emails(spark):
    assert one(spark, T.scrub_emails, "mail a.b@c.example.com.", "a@b", "a@b.com1", "@x") == ["mail [REDACTED-EMAIL].", "a@b", "a@b.com1", "@x"]


def test_definitions(spark):
    assert one(spark, T.definition, "pub async fn compute_tax(x)", "export class Order {", "let x = 1") == ["fn compute_tax", "class Order", None]


def test_sizes(spark):
    assert one(spark, T.size_of, "64k", "2MiB", "1g", "0", "junk", "12") == [65536, 2 << 20, 1 << 30, None, None, 12]


def test_globs(spark):
    rows = spark.createDataFrame([("src/**", "src/a.py", True), ("src/a", "src/ab", False), ("*", "x", True), ("a/b/*", "a", True)], "a string, b string, w boolean")
    assert all(r.g == r.w for r in rows.select("w", T.globs_collide(F.col("a"), F.col("b")).alias("g")).collect())


def test_test_paths(spark):
    assert one(spark, T.is_test_path, "src/core_test.rs", "tests/x.py", "a.spec.ts", "latest.py", "spec_helper.rb") == [True, True, True, False, True]


def test_lines_and_null(spark):
    assert one(spark, T.lines, "a\r\nb\n", "", None, "a\n\nb") == [["a", "b"], [], [], ["a", "", "b"]]

from pyspark.sql import functions as F

from doctax.functions import scores as S
from doctax.functions import text as X


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in columns.items()))
    return row.select(expr.alias("x")).first().x


def test_tokens_split_at_unicode_blanks(spark):
    text = "A b\u0085c　D e \t f."
    assert one(spark, X.tokens(F.col("t")), t=text) == text.lower().split()
    assert one(spark, X.word_count(F.col("t")), t="") == 0


def test_ids(spark):
    assert one(spark, X.bare_id(F.col("t")), t="R-1 Name of it") == "R-1"
    assert one(spark, X.bare_id(F.col("t")), t="R-1 ") == "R-1"
    assert one(spark, X.variant_parent(F.col("t")), t="a---b---c") == "a---b"
    assert one(spark, X.variant_parent(F.col("t")), t="a-b") is None


def test_taxonomy_by_prefix_order(spark):
    cases = {"atlas-x": "ibm-risk-atlas", "llm01": "owasp-llm-2.0", "mit-ai-causal-3": "mit-ai-risk-repository-causal", "nope": "unknown", "asi01": "owasp-asi"}
    for k, v in cases.items():
        assert one(spark, X.taxonomy_of(F.col("t")), t=k) == v


def test_budget_and_overflow(spark):
    rows = spark.createDataFrame([(100,), (2000,)], "n bigint").select(X.output_budget(F.col("n"), 2048, 1024).alias("x"))
    assert [r.x for r in rows.collect()] == [1024, 256]
    message = "maximum context length is 8192 tokens. You asked for 500 output tokens and 7000 input tokens"
    assert one(spark, X.reduced_output(F.col("t")), t=message) == 8192 - 7000 - 32
    assert one(spark, X.reduced_output(F.col("t")), t="other") is None


def test_truncation(spark):
    rows = spark.createDataFrame([(400,), (600,), (2000,)], "n bigint").select(X.truncated_length(F.col("n")).alias("x"))
    assert [r.x for r in rows.collect()] == [None, 500, 1200]


def test_evidence_and_f1(spark):
    assert one(spark, X.evidence_overlap(F.col("a"), F.col("b")), a="one two three four five", b="one two three x") == 0.6
    assert one(spark, X.evidence_overlap(F.col("a"), F.col("b")), a=" ", b="x") == 0.0
    assert abs(one(spark, X.token_f1(F.col("a"), F.col("b")), a="a b", b="b c d") - 0.4) < 1e-12
    assert one(spark, X.content_overlap(F.col("a"), F.col("b")), a="the risk of bias", b="bias and risk model") == 2 / 3


def test_cleaned_description(spark):
    assert one(spark, X.cleaned_description(F.col("a"), F.col("b")), a="Bias", b="bias is defined as if the x") == "x"
    assert one(spark, X.cleaned_description(F.col("a"), F.col("b")), a="Bias", b="other") == "other"


def test_scores(spark):
    assert one(spark, S.sigmoid(F.col("a")), a=0.0) == 0.5
    assert one(spark, S.clipped(F.col("a")), a=1.5) == 1.0
    assert one(spark, S.finite(F.col("a")), a=float("nan")) is None
    assert one(spark, S.finite(F.col("a")), a=float("inf")) is None
    assert abs(one(spark, S.last_softmax(F.array(F.lit(1.0), F.lit(2.0), F.col("a"))), a=3.0) - 0.66524) < 1e-5
    assert one(spark, S.yes_probability(F.col("a"), F.lit(None).cast("double")), a=-10.0) == 0.5


def test_small_forms(spark):
    assert one(spark, X.slug(F.col("t")), t=" Héllo, World! ") == "h-llo-world"
    assert one(spark, X.instructed(F.col("t"), "find"), t="q") == "Instruct: find\nQuery:q" and one(spark, X.instructed(F.col("t")), t="q") == "q"
    rows = spark.createDataFrame([(5,), (65,)], "s bigint").select(X.elapsed(F.col("s")).alias("x"))
    assert [r.x for r in rows.collect()] == ["5s", "1m 05s"]

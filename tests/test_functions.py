from pyspark.sql import functions as F

from plumbline.functions import grading as G
from plumbline.functions import masking as M
from plumbline.functions import names as N
from plumbline.functions import parsing as X
from plumbline.operators.logs import endpoint_template


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_masks(spark):
    emails = ["quill.rook@harbour.test", "", "vex@p.q", "w@p.q", "@p.q", "no sign", None]
    assert values(spark, emails, M.mask_email) == [
        "q****@harbour.test", "****", "v***@p.q", "****@p.q", "****@p.q", "****", None,
    ]
    assert values(spark, ["ösi@harbour.test", "w@p", "@p"], M.mask_email_preset) == ["ö****@harbour.test", "w****@p", "****@p"]
    assert values(spark, ["+49 30 901820", "77", " 4096\t"], M.mask_phone) == ["****1820", "****", "****4096"]
    assert values(spark, ["XK7700318264559Z2Q", "tiny"], M.mask_id_card) == ["XK7********9Z2Q", "****"]
    assert values(spark, ["DE02 7001 8844 3391"], M.mask_bank_account) == ["****3391"]
    assert values(spark, ["Ødegård", "Ng", "Q", ""], M.mask_name) == ["Ø**", "N**", "Q*", "****"]
    assert values(spark, ["5500 7312.8890-4467", "31"], M.mask_credit_card) == ["550073****4467", "****"]


def test_strip_space_takes_all_white_space(spark):
    assert values(spark, ["  a\t", " b\n", "c d"], M.strip_space) == ["a", "b", "c d"]


def test_grades(spark):
    assert values(spark, ["95", "85", "75", "65", "40"], lambda v: G.letter_grade(v.cast("double"))) == ["A", "B", "C", "D", "F"]
    assert values(spark, ["90", "75", "60", "0"], lambda v: G.word_grade(v.cast("double"))) == ["excellent", "good", "fair", "poor"]


def test_type_changes(spark):
    def breaking(old, new):
        return values(spark, ["x"], lambda v: G.is_breaking_type_change(F.lit(old), F.lit(new)))[0]

    assert breaking("REAL", "INTEGER") and not breaking("INTEGER", "REAL")
    assert breaking("varchar(10)", "int") is False and breaking("bigint", "string")
    assert breaking("date", "string") is False


def test_names(spark):
    assert values(spark, ["Order Items-2024", "x" * 60, "销售.表"], N.clean_name) == ["order_items_2024", "x" * 50, "销售_表"]
    assert N.clean_name_text("ods_Order Items-2024") == "ods_order_items_2024"
    assert N.matching_columns(["email", "EMAIL", "tel"], ["Email", "telephone", "x"]) == ["Email", "telephone"]
    assert N.matching_columns(["("], ["a"]) == []
    kinds = values(spark, ["email", "Telephone", "customer_name", "amount"], N.sensitive_kinds)
    assert kinds == [["email"], ["phone"], ["name"], []]
    jobs = values(spark, ["t.total_amount", "t.order_id", "t.note", "t.created_type"], N.jobs_of_node)
    assert jobs == [
        ["ETL_RevenueAggregation"], ["ETL_JoinMasterData"], ["ETL_GeneralTransform_T"], ["ETL_TimeDimensionJoin", "ETL_StatusFilter"],
    ]


def test_parsing(spark):
    assert values(spark, ["2024-13-99", "2024-1-2", " 2024-01-02 "], X.is_iso_date) == [True, False, True]
    assert values(spark, [" 12 ", "1.5", "x"], X.parse_integer) == [12, None, None]
    dtype = spark.createDataFrame([("a",)], "v string").schema["v"].dataType
    first, again, number = values(spark, ["abc", "abc", "2.5"], lambda v: X.as_number(v, dtype))
    assert first == again and 0 <= first < 10000 and number == 2.5


def test_endpoint_template(spark):
    paths = ["/api/orders/12/items", "/report.html", "/a1", "/"]
    assert values(spark, paths, endpoint_template) == ["/api/orders/{id}/items", "/report.html", "/{id}", "/"]


def test_numbers_in_text(spark):
    texts = ["1", " 2.5 ", "-.5", "1e3", "inf", "NaN", "north", "12ab", "", None]
    found = values(spark, texts, X.parse_number)
    assert found[:5] == [1.0, 2.5, -0.5, 1000.0, float("inf")] and found[5] != found[5]
    assert found[6:] == [None] * 4

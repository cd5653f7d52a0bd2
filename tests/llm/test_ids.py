"""Ids of 64 bits beside nulls come back as they were, from every operator and stage; rows are told apart by more than their id."""

import zlib

import pytest
from pyspark.sql import types as T

from marlstone.llm.decontaminate import contaminated, decontaminate
from marlstone.llm.html_text import extract_text
from marlstone.llm.language_id import identify_languages
from marlstone.llm.licences import scan_licences
from marlstone.llm.packing import best_fit_pack
from marlstone.llm.pieces import piece_digests
from marlstone.llm.quality_classifier import classify_quality
from marlstone.llm.quality_rules import keep_good, quality_rules
from marlstone.llm.simhash import drop_near_duplicates, simhash_groups
from marlstone.llm.suffix_dedup import remove_repeats, suffix_array_dedup
from marlstone.llm.warc import warc_round_trip

IDS = [2**53 + 1, 2**53 + 3, 2**63 - 1, None, -(2**62) - 1]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, other long, price decimal(38,2)"


def table(spark, texts):
    rows = [(i, t, "en", "web", None if i is None else len(t), i, None) for i, t in zip(IDS, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).coalesce(1)


def text(n, k=30):
    return " ".join(f"w{n}x{(n * 7919 + i * i * 31) % 977}" for i in range(k))


OPERATORS = {
    "op2": best_fit_pack, "op3": suffix_array_dedup, "op4": quality_rules, "op7": identify_languages, "op9": simhash_groups, "op13": piece_digests,
    "op8": lambda d: classify_quality(d, d.sparkSession.createDataFrame([(IDS[0], 1), (IDS[1], 0)], "doc_id long, quality int")),
    "stage9": drop_near_duplicates, "stage3": remove_repeats,
    "stage6": lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, text(99))], "item_id long, text string")),
    "op10": lambda d: scan_licences(d.selectExpr("doc_id", "concat('a/', coalesce(cast(doc_id as string), 'x')) as path", "text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay(spark, name):
    got = OPERATORS[name](table(spark, [text(n) for n in range(5)])).select("doc_id").collect()
    if name != "op10":
        assert {r[0] for r in got} == set(IDS)
    assert {r[0] for r in got} <= set(IDS)


def test_stages_keep_all_columns_exactly(spark):
    docs = table(spark, [text(n) for n in range(5)])
    want = sorted(map(tuple, docs.collect()), key=repr)
    for stage in (drop_near_duplicates, OPERATORS["stage6"]):
        out = stage(docs)
        assert out.schema == docs.schema and sorted(map(tuple, out.collect()), key=repr) == want
    out = remove_repeats(docs)
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert sorted((r.doc_id or 0, r.other or 0) for r in out.collect()) == sorted((i or 0, i or 0) for i in IDS)
    assert {r.other for r in keep_good(docs).collect()} <= set(IDS)


def test_pages(spark):
    body = "<p>" + "page " * 300
    pages = spark.createDataFrame([(i, None, body) for i in IDS] + [(None, "u", "x")], T.StructType.fromDDL("page_id long, url string, html string")).coalesce(1)
    assert {r.page_id for r in extract_text(pages).collect()} == set(IDS)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc_round_trip(pages).collect()), key=repr)
    top = 2**63 - 1
    want = [(i, "response" if i == top else "revisit", None if i == top else top) for i in IDS] + [(None, "response", None)]
    assert got == sorted(want, key=repr)
    alone = warc_round_trip(pages.where("page_id is null").union(pages.where("page_id is null"))).collect()
    assert [(r.page_id, r.record_type, r.refers_to) for r in alone] == [(None, "response", None)] * 4


def test_a_dirty_row_goes_alone(spark):
    item = text(99)
    docs = spark.createDataFrame([(1, item, 1), (1, text(3), 2), (None, "see " + item, 3), (None, text(4), 4)], "doc_id long, text string, n long")
    bench = spark.createDataFrame([(2**53 + 1, item), (None, item)], "item_id long, text string")
    assert sorted(r.n for r in decontaminate(docs, bench).collect()) == [2, 4]
    assert {r.item_id for r in contaminated(docs, bench).collect()} == {2**53 + 1, None}
    assert decontaminate(docs, bench.limit(0)).count() == 4 and decontaminate(docs.limit(0), bench).count() == 0


def test_language_of_equal_texts_goes_to_the_first_name(spark):
    learned = [n for n in range(100) if zlib.crc32(str(n).encode()) % 5][:30]
    docs = spark.createDataFrame([(n, "abc def ghi", x) for n, x in zip(learned, ["zz", "aa", "mm"] * 10, strict=True)], "doc_id long, text string, lang string")
    got = identify_languages(docs).collect()
    assert {r.lang_pred for r in got} == {"aa"} and all(0 <= r.score <= 1 for r in got)
    assert identify_languages(docs.limit(0)).count() == 0

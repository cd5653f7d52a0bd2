"""Record rules, strict catalogue files and the cap map."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import records
from marlstone.operators import sphere
from marlstone.sources import catalogue_files

GOOD = "레몬의 새콤한 산미가 입안을 환하게 채우며 산뜻하고 가볍게 퍼진다. 이어서 달콤한 꿀 향이 부드럽게 감돌고 청량한 기포가 경쾌하게 터진다. 마지막에는 허브의 향긋함이 길게 남아 전체 인상을 화사하게 마무리한다."
PROFILE = "struct<sweetness:string,acidity:string,body:string,carbonation:string,creaminess:string,alcohol_presence:string,notes:array<string>>"


def problems(spark, text, **facets):
    profile = {f: facets.get(f) for f in ("sweetness", "acidity", "body", "carbonation", "creaminess", "alcohol_presence", "notes")}
    row = spark.createDataFrame([(text, tuple(profile.values()))], f"t string, p {PROFILE}")
    return row.select(records.prose_problems(F.col("t"), F.col("p"))).first()[0]


def test_prose(spark):
    assert problems(spark, GOOD, sweetness="high", body="light", notes=["레몬", "딸기"]) == []
    assert problems(spark, f"  {GOOD}\n ") == [] and problems(spark, None) == ["missing"]
    assert problems(spark, "짧다.") == ["length", "sentences"]
    assert problems(spark, GOOD[:-1] + " 단맛이 없다") == ["ending", "negative: 없"]
    assert problems(spark, GOOD.replace("레몬", "레몬 3%")) == ["labels or numbers"]
    assert problems(spark, GOOD.replace("향이", "색상이")) == ["not sensory: 색상"]
    assert problems(spark, GOOD.replace("입안을", "잔을")) == ["glass"]
    got = problems(spark, GOOD, sweetness="low", acidity="none", body="full", carbonation="very_low", alcohol_presence="high", notes=["딸기"])
    assert got == ["sweetness", "acidity", "full body", "carbonation", "alcohol", "notes"]
    assert problems(spark, GOOD + " 온기가 남는다.", alcohol_presence="none") == ["no alcohol"]
    assert problems(spark, GOOD + " 크리미하다. 또 남는다.", creaminess="low") == ["sentences", "creaminess"]


def test_amounts_keys_and_features(spark):
    rows = spark.createDataFrame([(2.0, " OZ "), (None, "ml"), (0.01, "dash"), (3.0, None), (3.0, "leaf")], "a double, u string")
    want = [math.log1p(2 * 29.5735), math.log1p(1), math.log1p(0.1), math.log1p(3), math.log1p(3)]
    assert [r[0] for r in rows.select(records.ingredient_weight(F.col("a"), F.col("u"))).collect()] == pytest.approx(want)
    key = spark.range(1).select(records.selection_key(F.lit(7), F.array(F.lit(12), F.lit(3), F.lit(101)))).first()[0]
    assert key == "7,3,12,101"
    prints = spark.createDataFrame([("a", None), ("a", ""), (None, "a")], "a string, b string").select(records.content_fingerprint(F.col("a"), F.col("b"))).collect()
    assert len({r[0] for r in prints}) == 3
    recipe = {"method": "shake", "mixing_ice": None, "carbonation": True, "serving_ice": {"kind": "cube"}, "estimated_pre_dilution_abv": 23.9, "ingredients": [{"canonical_name": "gin", "category": "spirit", "presence_only": True}, {"canonical_name": "lime", "category": "fruit"}, {"canonical_name": 5}]}
    lines = [(json.dumps(recipe),), (json.dumps({"ingredients": []}),), ("no json",), (None,), (json.dumps({"ingredients": [{}] * 11, "estimated_pre_dilution_abv": -3}),)]
    got = [r[0] for r in spark.createDataFrame(lines, "r string").select(records.recipe_features(F.col("r"))).collect()]
    assert got[0] == sorted(["method:\"shake\"", "carbonation:true", "ingredient_count:3", "abv_bin_5:20", "ingredient_canonical_name:\"gin\"", "ingredient_canonical_name:\"lime\"", "ingredient_canonical_name:5", "ingredient_category:\"spirit\"", "ingredient_category:\"fruit\"", "ingredient_presence_only:true"])
    assert got[1:4] == [None] * 3 and got[4] == ["abv_bin_5:0", "ingredient_count:8"]


def test_files(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text, encoding="utf-8")
        return str(tmp_path / name)

    head = "cocktail_id,cocktail_name_ko,cocktail_name_en,embedding_text,updated_at\n"
    good = write("t.csv", "﻿" + head + '2, 나 ,n,"a ""b"", c",x\n1,가,,t,\n')
    assert sorted(map(tuple, catalogue_files.read_taste(spark, good).collect())) == [(1, "가", "t"), (2, "나", 'a "b", c')]
    for body in ("1,가,,t,\n", "1,가,,t,\n1,나,,t,\n", "1,가,,t,\n-2,나,,t,\n", "1,가,,t,\nx,나,,t,\n", "1,가,,t,\n2, ,,t,\n", "1,가,,t,\n2,나,,,\n"):
        with pytest.raises(ValueError):
            catalogue_files.read_taste(spark, write("bad.csv", head + body))
    assert catalogue_files.read_coordinates(spark, write("c.csv", "cocktail_id,x,y,z\n7,0.0,1.0,0.0\n")).count() == 1
    for body in ("", "7,0.0,1.0,0.0\n7,0.0,1.0,0.0\n", "07,0.0,1.0,0.0\n", "7,NaN,1.0,0.0\n", "7,,1.0,0.0\n"):
        with pytest.raises(ValueError):
            catalogue_files.read_coordinates(spark, write("bad2.csv", "cocktail_id,x,y,z\n" + body))
    edges = "run_id,source_id,target_id,rank,cosine\nr,1,2,1,0.5\nr,1,3,2,0.4\n"
    assert [tuple(r) for r in catalogue_files.read_expected(spark, write("e.csv", edges), 2).collect()] == [("1", ["2", "3"])]
    for extra in ("r,1,2,3,0.1\n", "r,2,2,1,0.1\n", "r,2,1,1,0.1\n"):
        with pytest.raises(ValueError):
            catalogue_files.read_expected(spark, write("bad3.csv", edges + extra), 2)


def test_cap(spark):
    r = np.random.default_rng(1)
    p = r.normal(size=(40, 2))
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, px double, py double")
    got = np.array([[x.x, x.y, x.z] for x in sphere.spherical_cap(rows, (0.0, 3.0, 4.0), 0.6, 0.9).orderBy("id").collect()])
    flat = p - p.mean(axis=0)
    length = np.linalg.norm(flat, axis=1)
    want = np.minimum(1, length / np.quantile(length, 0.9)) * 0.6
    assert np.allclose(np.linalg.norm(got, axis=1), 1) and np.allclose(np.arccos(np.clip(got @ [0, 0.6, 0.8], -1, 1)), want, atol=1e-7)
    with pytest.raises(ValueError):
        sphere.spherical_cap(rows.withColumn("px", F.lit(1.0)).withColumn("py", F.lit(1.0)), (0, 0, 1), 0.5)
    assert sphere.spherical_cap(rows.limit(0), (0.0, 0.0, 1.0), 0.5).count() == 0

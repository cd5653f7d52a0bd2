"""Rules and features of single records as Spark expressions: generated prose, recipes as JSON, ingredient amounts, cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What generated prose must not say, and what it must or must not say for a profile's facets.
NEGATIVE = ["없", "않", "아니(?:다|며|고|지만|라|어서|므로)", "낮(?:음|다|은|게)", "약(?:함|한|하게)", "미포함", "무탄산", "비탄산", "무알코올", "논알코올", "제로"]
NOT_SENSORY = "색상 색깔 색채 투명 불투명 탁한 레이어 글라스 가니시 장식 외관 비주얼 역사 유래 기원 인기 분위기".split()
GLASS = "잔(?:에|을|이|의|모양|속)"
SWEET = "단맛 달콤 당도 스위트 디저트".split()
ACID = "산미 새콤 시큼".split()
LIGHT = "가볍 라이트 산뜻 청량 경쾌".split()
FULL = "밀도 묵직 리치 실키 벨벳 점성".split()
ALCOHOL = "알코올 스피릿 에탄올 도수 열감 온기".split()
FIZZ = "탄산 기포 버블".split()
CREAM = ["크리미"]
LOW = ["none", "very_low", "low"]
# Millilitres of a unit; other units count as they are.
UNITS = {"ml": 1.0, "oz": 29.5735, "tsp": 4.92892, "dash": 0.92}


def _any(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(text, F.lit(term))
    return found


def prose(text: Column) -> Column:
    """The text with runs of white space as one blank and none at either end."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def prose_problems(text: Column, profile: Column) -> Column:
    """Names of the rules that a text breaks, in order; empty if it is sound, ``missing`` alone for a null.

    ``profile`` is a struct of sweetness, acidity, body, carbonation, creaminess, alcohol_presence (levels as text) and notes
    (array of names of which one must be mentioned, if there are any). Null facets demand nothing.
    """
    t = prose(text)
    level = lambda name: F.coalesce(profile[name], F.lit(""))
    sentences = F.size(F.regexp_extract_all(t, F.lit(r"([.!?])(?=\s|$)"), F.lit(1)))
    notes = F.coalesce(profile["notes"], F.array().cast("array<string>"))
    rules = [
        ("length", ~F.length(t).between(80, 500)),
        ("ending", ~t.rlike("[.!?]$")),
        ("sentences", ~sentences.between(2, 4)),
        ("labels or numbers", t.rlike(r"[|=%]|\p{Nd}")),
        *[(f"negative: {p}", t.rlike(p)) for p in NEGATIVE],
        *[(f"not sensory: {w}", F.contains(t, F.lit(w))) for w in NOT_SENSORY],
        ("glass", t.rlike(GLASS)),
        ("sweetness", level("sweetness").isin(LOW) & _any(t, SWEET)),
        ("acidity", level("acidity").isin(LOW) & _any(t, ACID)),
        ("light body", level("body").isin("very_light", "light") & ~_any(t, LIGHT)),
        ("full body", level("body").isin("full", "very_full") & ~_any(t, FULL)),
        ("carbonation", level("carbonation").isin(LOW) & _any(t, FIZZ)),
        ("creaminess", level("creaminess").isin(LOW) & _any(t, CREAM)),
        ("no alcohol", (level("alcohol_presence") == "none") & _any(t, ALCOHOL)),
        ("alcohol", level("alcohol_presence").isin("high", "very_high") & ~_any(t, ALCOHOL)),
        ("notes", (F.size(notes) > 0) & ~F.exists(notes, lambda n: F.contains(t, n))),
    ]
    broken = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]))
    return F.when(text.isNull(), F.array(F.lit("missing"))).otherwise(broken)


def ingredient_weight(amount: Column, unit: Column) -> Column:
    """log(1 + millilitres), at least those of 0.1 ml; a null amount is 1, an unknown or null unit counts as it is."""
    factor = F.lit(1.0)
    for name, ml in UNITS.items():
        factor = F.when(F.lower(F.trim(unit)) == name, F.lit(ml)).otherwise(factor)
    return F.log1p(F.greatest(F.coalesce(amount.cast("double"), F.lit(1.0)) * factor, F.lit(0.1)))


def recipe_features(recipe: Column) -> Column:
    """The sorted features of a recipe as JSON: scalars of the method, ice and carbonation, the ingredients' names and categories, their number up to 8, the strength in steps of 5. Null for what is no object with ingredients."""
    v = F.try_parse_json(recipe)
    scalar = lambda x, path, prefix: F.when(F.regexp_like(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit("^(STRING|BIGINT|BOOLEAN|DOUBLE|DECIMAL.*)$")), F.concat(F.lit(f"{prefix}:"), F.to_json(F.try_variant_get(x, path, "variant"))))
    parts = F.try_variant_get(v, "$.ingredients", "array<variant>")
    each = F.flatten(F.transform(parts, lambda i: F.array(scalar(i, "$.canonical_name", "ingredient_canonical_name"), scalar(i, "$.category", "ingredient_category"), F.when(F.try_variant_get(i, "$.presence_only", "boolean"), F.lit("ingredient_presence_only:true")))))
    abv = F.try_variant_get(v, "$.estimated_pre_dilution_abv", "double")
    number = F.regexp_like(F.schema_of_variant(F.try_variant_get(v, "$.estimated_pre_dilution_abv", "variant")), F.lit("^(BIGINT|DOUBLE|DECIMAL.*)$"))
    strength = F.when(number & ~F.isnan(abv), F.concat(F.lit("abv_bin_5:"), (F.floor(F.greatest(abv, F.lit(0.0)) / 5) * 5).cast("string")))
    fields = [scalar(v, f"$.{f}", f) for f in ("method", "mixing_ice", "serving_ice", "carbonation")]
    count = F.concat(F.lit("ingredient_count:"), F.least(F.size(parts), F.lit(8)).cast("string"))
    return F.when(F.size(parts) > 0, F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(*fields, count, strength), each)))))


def selection_key(epoch: Column, ids: Column) -> Column:
    """A cache key of a selection, whatever the order of its ids."""
    return F.concat_ws(",", epoch.cast("string"), F.array_sort(ids).cast("array<string>"))


def content_fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts as JSON with nulls kept, so that a null and an absent part differ from an empty one."""
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)

"""Each stage of the pipeline against a plain version of it, on the stage's own input."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

from .test_operators import plain_perplexities, removed

SF = "/root/testdata/sf0.001"


def plain_quality(rows):
    from marlstone.llm.quality_rules import FEW_DEVIATION, FEW_TEXTS, LOWER_BAND, MIN_DEVIATION, SHORT, UPPER_BAND

    def failed(text):
        words = text.split()
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        many, hit = Counter(windows), set()
        for i, w in enumerate(windows):
            if many[w] > 1:
                hit |= set(range(i, i + 8))
        return len(words) < 20 or 100 * len(hit) > 30 * len(words)

    texts = {(r.lang or "", r.text) for r in rows if r.text}
    level = plain_perplexities(texts)
    sound = {}
    for lang, t in texts:
        if not failed(t):
            sound.setdefault(lang, []).append((level[lang, t], np.sqrt(1 + SHORT / len(t))))
    mid = {lang: np.median([x for x, _ in v]) for lang, v in sound.items()}
    off = {lang: sorted(abs(x - mid[lang]) / w for x, w in v) for lang, v in sound.items()}
    middle = lambda v: 1.4826 * v[(len(v) - 1) // 2]
    pooled = sorted(x for v in off.values() if len(v) >= FEW_TEXTS for x in v)
    kept = set()
    for lang, t in texts:
        if lang in mid and not failed(t):
            few = max(middle(pooled) if pooled else 0, FEW_DEVIATION)
            dev = max(middle(off[lang]), few if len(off[lang]) < FEW_TEXTS else MIN_DEVIATION)
            z = (level[lang, t] - mid[lang]) / dev / np.sqrt(1 + SHORT / len(t))
            if -LOWER_BAND <= z <= UPPER_BAND:
                kept.add((lang, t))
    return sorted(r.doc_id for r in rows if (r.lang or "", r.text) in kept)


def plain_groups(rows):
    def fingerprint(text):
        ws = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        h = [xxhash.xxh64_intdigest(b" ".join(ws[i : i + 3]), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=int) if h else np.zeros(64, int)
        return sum(1 << b for b in range(64) if 2 * bits[b] > len(h))

    marks = [(r.doc_id, fingerprint(r.text)) for r in rows]
    group = {d: d for d, _ in marks}
    changed = True
    while changed:
        changed = False
        for d, f in marks:
            least = min(group[e] for e, g in marks if (f ^ g).bit_count() <= 3)
            if least < group[d]:
                group[d], changed = least, True
    return sorted(set(group.values()))


def plain_leaks(rows, items):
    bad = set()
    for item in items:
        ws = (item.text or "").lower().split()
        if not ws:
            continue
        k = min(5, len(ws))
        own = Counter(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1))
        m = sum(own.values())
        for r in rows:
            doc = (r.text or "").lower().split()
            grams = [tuple(doc[j : j + k]) for j in range(len(doc) - k + 1)]
            if sum(g in own for g in grams) < 0.8 * m / 1.8:
                continue
            for s in range(max(1, len(grams) - m + 1)):
                window = Counter(grams[s : s + m])
                both = sum((window & own).values())
                if both / (sum(window.values()) + m - both) >= 0.8:
                    bad.add(r.doc_id)
                    break
    return bad


def test_every_stage_decides_as_its_plain_version(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs, outputs = docs.columns, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.orderBy("doc_id").collect()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        outputs[name] = docs.collect()
        assert name == "best_fit_packing" or docs.columns == columns
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(outputs["quality_rules"]) == plain_quality(inputs["quality_rules"])
    assert ids(outputs["simhash_near_dedup"]) == plain_groups(inputs["simhash_near_dedup"])
    before = inputs["suffix_array_dedup"]
    after = {r.doc_id: r for r in outputs["suffix_array_dedup"]}
    assert sorted(after) == ids(before)
    for r, (_, _, _, digest) in zip(before, removed([r.text for r in before], 200)):
        left = after[r.doc_id].text
        # (a character of which a part is cut goes whole)
        assert hashlib.sha256(left.encode()).hexdigest() == digest or (not r.text.isascii() and len(left) <= len(r.text))
        assert after[r.doc_id].n_chars == len(left)
    before = inputs["benchmark_decontamination"]
    bad = plain_leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    assert bad and ids(outputs["benchmark_decontamination"]) == sorted(set(ids(before)) - bad)
    packed = outputs["best_fit_packing"]
    assert {r.doc_id for r in packed} == set(ids(inputs["best_fit_packing"]))
    ends = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 1024

"""Training-data operators against brute force, on edge cases and on small random tables."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from talkspan.llm import common, components, decontam, editcount, jaccard, langid, licences, ordinal, packing, rules, shards, simhash, suffix, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, part int, key string, kept string"
EDGE = ["", None, "a", " \n\t ", "A b", "word " * 3000, "é漢字 x" * 40, "<|endoftext|> twice <|endoftext|>", "x" * 400, "ab" * 300]


def table(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 2 else None, "s" if i % 3 else None, len(t or ""), "c", 1, "k", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    parts = ["".join(r.choice("abcdé ") for _ in range(r.randint(20, 260))) for _ in range(8)]
    out = []
    for _ in range(60):
        t = " ".join(r.choice(parts) + "".join(r.choice("abcdé ") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 4)))
        out.append(t)
    return out + EDGE + [out[3], out[3]]


def test_suffix_dedup(spark, texts, monkeypatch):
    def brute(docs, size):
        seen, out = set(), {}
        for i, t in docs:
            b = (t or "").encode()
            gone = np.zeros(len(b), bool)
            for p in range(len(b) - size + 1):
                if b[p : p + size] in seen:
                    gone[p : p + size] = True
                seen.add(b[p : p + size])
            out[i] = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        return out

    docs = table(spark, texts)
    for hot, part in ((2000, 1 << 25), (2, 1 << 25), (2000, 200)):
        monkeypatch.setattr(suffix, "HOT_FRAGMENTS", hot)
        monkeypatch.setattr(suffix, "HOT_PART_BYTES", part)
        got = {r["doc_id"]: bytes(r["kept"]) for r in suffix.repeated_spans(docs).collect()}
        assert got == brute(list(enumerate(texts)), 100)
    left = suffix.drop_repeats(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        assert r["text"] and r["n_chars"] == len(r["text"])


def test_simhash(spark, texts):
    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    want = [fp(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (want[i] ^ want[j]).bit_count() <= 3 and root[i] != root[j]:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    assert got == {i: (f"{want[i]:016x}", root[i]) for i in range(len(texts))}
    kept = simhash.drop_near_duplicates(table(spark, texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root))


def test_simhash_balls():
    r = np.random.default_rng(3)
    fps = {0}
    for b in r.integers(0, 2**64, 30, dtype=np.uint64):
        for _ in range(12):
            x = int(b)
            for k in r.integers(0, 64, r.integers(0, 6)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)

    def roots(pairs):
        up = {int(x): int(x) for x in fps}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = sorted((find(int(a)), find(int(b))))
            up[b] = a
        return {x: find(x) for x in up}

    want = roots([(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if int(a ^ b).bit_count() <= 3])
    for parts in (1, 128):
        flips = simhash.Flips(parts)
        part, fp = simhash.deal(flips, fps)
        pairs = [p for k in np.unique(part) for p in zip(*simhash.meet(flips, int(k), fp[part == k]))]
        assert all(int(a ^ b).bit_count() <= 3 for a, b in pairs)
        assert roots(pairs) == want


def test_components(spark):
    r = random.Random(2)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(40)] + [(5, None)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = {}
    for a, b in pairs:
        if b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want


def test_rules(spark, texts):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again)

    got = {r["doc_id"]: r for r in rules.judge(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in rules.STATS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])


def test_mcd_ignores_outliers():
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 1, (80, 5)), r.normal(50, 1, (15, 5))])
    best = rules.small_mcd(x)
    assert [d for d, _, _ in best] == sorted(d for d, _, _ in best) and len(best) <= rules.STARTS
    _, mu, cov = best[0]
    assert np.abs(mu).max() < 1 and (rules.distances(x, mu, cov)[80:] > rules.CUTOFF).all()


def test_tokens_equal_library():
    enc, r = tokens.encoder(), random.Random(0)
    for _ in range(3000):
        t = "".join(r.choice(["ab", "'s", " ", "é", "\n", "\t", "12", "漢", " ", "　", "😀", "<|endoftext|>"]) for _ in range(r.randint(0, 30)))
        assert enc.ids(t) == enc.exact.encode(t, add_special_tokens=False).ids


def test_packing(spark, texts, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 12)
    enc = tokens.encoder()
    rows = packing.pack_documents(table(spark, texts)).collect()
    own, bins = {}, {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        n = len(enc.array(t))
        pieces = sorted(own[i], key=lambda r: r["piece"])
        assert [(p["start"], p["length"]) for p in pieces] == packing.cuts(n) and sum(p["length"] for p in pieces) == n
        assert all(p["length"] == packing.LIMIT for p in pieces[1:]) and (n > packing.LIMIT or len(pieces) == 1)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.LIMIT
    total = sum(r["length"] for r in rows)
    assert len(bins) <= math.ceil(total / packing.LIMIT) + 3


def test_shards(spark, texts, tmp_path):
    enc = tokens.encoder()
    for n in (1, 2, 3, 17, 1000):
        assert sorted(shards.permute(np.arange(n), n, 9).tolist()) == list(range(n))
    order = shards.training_order(table(spark, texts), length=32, per_shard=16)
    rows = order.collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and all(r["shard"] == r["slot"] // 16 for r in rows)
    back = {}
    for r in rows:
        back.setdefault(r["doc_id"], {})[r["sequence"]] = np.frombuffer(r["ids"], "<u2")[: r["n_tokens"]].tolist()
    for i, t in enumerate(texts):
        assert sum((back[i][k] for k in sorted(back[i])), []) == enc.array(t).tolist()
    shards.write_shards(order, f"file://{tmp_path}/out")
    files = {k: b"".join(f.read_bytes() for f in sorted((tmp_path / "out" / f"shard={k}").glob("part-*"))) for k in {r["shard"] for r in rows}}
    for r in rows:
        assert files[r["shard"]][r["byte_offset"] : r["byte_offset"] + 64] == bytes(r["ids"])
    part = shards.read_shard(spark, f"file://{tmp_path}/out", 1, length=32, first=3)
    assert [x.tobytes() for x in part] == [bytes(r["ids"]) for r in sorted(rows, key=lambda r: r["slot"]) if 19 <= r["slot"] < 32]


def test_wand_equals_all_scores():
    r = random.Random(4)
    items = [(k, " ".join(f"w{r.randrange(40)}" for _ in range(r.randint(5, 30))) + ".") for k in range(300)]
    for threshold in (0.4, 1.0):
        index = decontam.Index(items, threshold)
        for _ in range(60):
            terms = sorted(r.sample(range(len(index.vocabulary)), r.randint(1, 30)))
            score = np.zeros(len(index.ids))
            for t in terms:
                for k, x in zip(*index.lists[t]):
                    score[k] += x
            want = {k for k in range(len(score)) if score[k] >= threshold - 1e-9}
            assert {k for k, _ in index.retrieve(terms)} == want
            assert {k for b in range(index.n_blocks) for k, _ in index.retrieve(terms, b)} == want


def test_leaks(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(20)).capitalize() + ". " + " ".join(word() for _ in range(8)) + ".") for k in range(30)]
    docs = [" ".join(word() for _ in range(300)) for _ in range(40)] + EDGE
    docs[3] = docs[3][:400] + " " + items[7][1].upper() + " " + docs[3][400:]
    docs[9] = items[2][1].replace(" ", "\n")
    docs[11] += " " + items[5][1].split(". ")[0]  # the question alone
    bench = spark.createDataFrame(items + [(99, None), (98, "")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_leaks(table(spark, docs), bench).collect()}
    assert got == {(3, 7), (9, 2)}
    left = decontam.drop_leaks(table(spark, docs), bench)
    assert left.count() == len(docs) - 2
    whole = {tuple(x) for x in decontam.find_leaks(table(spark, docs), bench).collect()}
    parts = {tuple(x) for x in decontam.find_leaks(table(spark, docs), bench, part_items=7).collect()}
    assert {x[:2] for x in parts} == {x[:2] for x in whole} and np.allclose(sorted(x[2:] for x in parts), sorted(x[2:] for x in whole))


def test_leaks_against_every_pair():
    """All passages against all items by shingles, without the index, over more items than one block holds."""
    r = random.Random(18)
    word = lambda: f"w{r.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(r.randint(6, 30))) + ". " + " ".join(word() for _ in range(r.randint(1, 7))) + ".") for k in range(150)]
    docs = []
    for _ in range(40):
        t = [word() for _ in range(r.randint(0, 90))]
        for _ in range(r.randint(0, 3)):
            own = items[r.randrange(150)][1].split()
            lo, hi = r.randint(0, len(own) // 9), len(own) - r.randint(0, len(own) // 9)
            at = r.randint(0, len(t))
            t[at:at] = own[lo:hi]
        docs.append(" ".join(t))
    index = decontam.Index(items)
    assert index.n_blocks > 10
    want = set()
    for d, t in enumerate(docs):
        w = decontam.words_of(t)
        for k in range(len(items)):
            size = len(index.words[k])
            whole = index.verify(k, w)
            if whole[0] >= decontam.OVERLAP and min(whole[1:]) >= decontam.PART_OVERLAP:
                # the shingles must lie in one passage: two neighbouring stretches of the longest item's length
                passages = [w[a : a + 2 * index.length] for a in range(0, max(1, len(w)), index.length)]
                got = [index.verify(k, p) for p in passages]
                if any(s[0] >= decontam.OVERLAP and min(s[1:]) >= decontam.PART_OVERLAP for s in got):
                    want.add((d, k))
            assert size <= index.length
    found = {h[:2] for h in index.search(pa.array(docs))}
    assert found == want and len(want) > 15


def test_leaks_at_exactly_the_overlap():
    for n in (5, 10, 20, 25, 50):
        words = [f"w{k}" for k in range(n + 4)]
        text = " ".join(words[: n // 2 + 2]) + ". " + " ".join(words[n // 2 + 2 :]) + "."
        others = [(k, " ".join(f"w{j}" for j in range(9, 90, 2 + k % 5)) + ".") for k in range(1, 30)]
        index = decontam.Index([(0, text), *others])
        for cut in range(n // 5 + 1):  # the copy lacks n / 5 words, so n / 5 shingles, at its ends
            copy = " ".join(words[cut : len(words) - n // 5 + cut])
            found = {h[1] for h in index.search(pa.array([copy.replace("w", "W")]))}
            good = index.verify(0, [w.encode() for w in copy.split()])
            assert good[0] == 0.8 and (0 in found) == (min(good[1:]) >= 0.5)


def test_language():
    r = random.Random(6)
    samples = {"aa": " ".join("".join(r.choice(["ka", "lo", "mi"]) for _ in range(3)) for _ in range(300)), "bb": " ".join("".join(r.choice(["tré", "su", "ny"]) for _ in range(3)) for _ in range(300))}
    model = langid.Model(samples, stretch=64)
    texts = ["kalomi lomika", "trésuny nytré su" * 20, "", "123 !?", "漢字", None]
    lang, score = model.predict(pa.array(texts))
    assert lang[:4] == ["aa", "bb", "und", "und"] and lang[5] == "und" and ((score >= 0) & (score <= 1)).all()

    def brute(text, sample):
        fold = lambda x: bytes(langid.FOLD[np.frombuffer(x.lower().encode(), np.uint8)])
        t, s, n, cur = fold(text), fold(sample), 0, b""
        for c in t:  # the whole text in one go, whatever the stretch
            c = bytes([c])
            if cur + c in s:
                cur += c
            else:
                n, cur = n + 1, (c if c in s else b"")
        return n + (len(t) > 0)

    texts += [" ".join(r.choice(["kalomi", "suny", "tré", "m-m", "lo"]) for _ in range(r.randint(1, 400))) for _ in range(12)]
    texts.append("kalomikalomi" * 300)  # phrases longer than a stretch
    want = [[brute(t or "", samples[c]) for c in model.languages] for t in texts]
    for stretch in (3, 64, 256):
        model.stretch = stretch
        count, _ = model.counts(pa.array([t or "" for t in texts]))
        assert count.tolist() == want


def test_language_with_little_text():
    """A language of which little is labelled still wins its own texts: phrases are weighed by the size of the sample."""
    rows = [(r["lang"], r["text"]) for r in _sample_documents()]
    by = {}
    for lang, text in rows:
        by.setdefault(lang, []).append(text)
    samples = {k: "\n".join(v[:12])[: 40_000 if k != "fr" else 1_500] for k, v in by.items()}
    lang, _ = langid.Model(samples).predict(pa.array([t for k, v in by.items() for t in v[12:40]]))
    want = [k for k, v in by.items() for _ in v[12:40]]
    assert sum(a == b for a, b in zip(lang, want)) > 0.97 * len(want)


def _sample_documents():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["lang", "text"])
    return [r for r in t.to_pylist() if r["lang"] and r["text"] and len(r["text"].split()) >= 30]


def test_language_sample_bounds(spark):
    texts = ["ab " * 4000, *["cd " * 200] * 8, "ef"]
    rows = [(i, t, "x" if i else "y") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.training_sample(docs, rows=4, document_bytes=1000, language_bytes=1500)
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert 0 not in held and got["y"] == texts[0][:1500]  # a language's only text counts whatever its size, up to the bound
    assert len(got["x"].encode()) <= 1500 + 3 and set(got["x"].split()) <= {"cd", "ef"}
    many = spark.createDataFrame([(i, "t", f"l{i}") for i in range(400)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.training_sample(many)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)
    assert langid.identify(table(spark, EDGE)).count() == len(EDGE)


def test_ordinal_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = ordinal.fit(docs, labels, share=0.7)
    assert model.thresholds[0] < model.thresholds[1]
    held = ordinal.rated_documents(docs, labels, 10**6, 0.7, held_out=True).collect()
    used = ordinal.rated_documents(docs, labels, 10**6, 0.7).collect()
    assert len(held) > 60 and len(held) + len(used) == labels.join(docs, "doc_id").select("doc_id").distinct().count()
    chosen = model.tails(model.scores(pa.array([r["text"] for r in held])))[:, 1] >= ordinal.SELECT_AT
    good = np.array([r["grade"] == 2 for r in held])
    assert chosen[good].mean() > 0.95 and chosen[~good].mean() < 0.5
    empty = labels.limit(0)
    assert all(r["selected"] is None for r in ordinal.grade_documents(docs, empty).collect())


def test_ordinal_reads_whole_words_and_bounds_rows(spark):
    a, b = "x" * 100 + "a", "x" * 100 + "b"
    row, feat, _ = ordinal.features(pa.array([a, b, a + " " + b]))
    words = [set(feat[(row == k) & (feat < ordinal.WORD_BUCKETS)].tolist()) for k in range(3)]
    assert words[0] != words[1] and words[2] == words[0] | words[1]
    docs = spark.createDataFrame([(1, "a b"), (1, "c d"), (1, "a b"), (2, "e"), (None, "f")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = ordinal.rated_documents(docs, labels).collect()
    assert sorted(r["grade"] for r in got) == [0, 2] and len(got) == 2


def test_ordinal_equals_a_plain_fit():
    """The gradient is that of the ordinal likelihood: no step along any weight or threshold of the result gains much."""
    r = np.random.default_rng(3)
    n, p = 400, 12
    x = r.random((n, p)) < 0.3
    score = x @ np.linspace(-3, 3, p) + r.logistic(size=n)
    grade = np.digitize(score, [-1.0, 1.0])
    row, feat = np.nonzero(x)
    model = ordinal.Model.fit(row, feat, np.ones(len(row)), grade, 3, steps=3000, rate=0.3, decay=0.0)

    def loss(w, cut):
        s = x @ w
        edge = np.concatenate([[-40.0], cut, [40.0]])
        return -np.log(ordinal._logistic(edge[grade + 1] - s) - ordinal._logistic(edge[grade] - s)).mean()

    w, cut = model.weights[:p].astype(float), model.thresholds
    best = loss(w, cut)
    for k in range(p):
        for step in (-0.05, 0.05):
            assert loss(w + step * (np.arange(p) == k), cut) > best - 1e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, cut + step * (np.arange(2) == k)) > best - 1e-4
    assert np.corrcoef(w, np.linspace(-3, 3, p))[0, 1] > 0.95


def test_licences():
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software"
    assert licences.scan("Words.\nReleased under the MIT License.\nMore.")[1] == ["MIT"]
    assert licences.scan("Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.")[1] == ["Apache-2.0", "CC-BY-NC-4.0"]
    assert licences.scan("This work is licensed under the GNU General Public License, version 3.")[1] == ["GPL-3.0-only"]
    assert licences.scan(mit)[1] == [] and licences.scan(None) == ([], []) and licences.scan("the licence of the poet") == ([], [])
    bsd = {i: s for i, s in licences.SENTENCES if i.startswith("bsd")}
    assert licences.scan(" ".join(bsd[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")))[1] == ["BSD-2-Clause"]
    apart = " ".join([bsd["bsd-grant"], bsd["bsd-source"], "All rights reserved.", bsd["bsd-binary"]])
    assert licences.scan(apart)[1] == ["Proprietary"]  # the identifiers of a rule follow each other


def test_every_licence_sentence_and_rule():
    first = {}
    for i, s in licences.SENTENCES:
        first.setdefault(i, s)
        assert licences.identifiers(licences.normal(s)) == [i]
    for name, need in licences.RULES:
        for wrap in (" ", "\n", "\n * "):
            text = wrap.join(first[x] for x in need).replace(" ", wrap)
            if need[0].startswith("more:"):  # a part of an expression counts behind its beginning only
                assert licences.scan("Prose before. " + text + ". Prose after.")[1] == []
                assert licences.scan("SPDX-License-Identifier: ISC " + text)[1] == list(dict.fromkeys(["ISC", name]))
                continue
            assert licences.scan("Prose before. " + text + ". Prose after.")[1] == [name]


def test_licence_walk_equals_brute_force():
    r = random.Random(4)
    known = {}
    for i, s in licences.SENTENCES:
        known.setdefault(tuple(licences.normal(s)), i)
    words = sorted({w for s in list(known)[:120] for w in s})
    for _ in range(300):
        text = []
        for _ in range(r.randint(0, 6)):
            own = list(r.choice(list(known)))
            text += own[r.choice([0, 0, 1]) : len(own) - r.choice([0, 0, 1])] + [r.choice(words) for _ in range(r.randint(0, 3))]
        want, at = [], 0
        while at < len(text):
            fit = [n for n in range(len(text) - at, 0, -1) if tuple(text[at : at + n]) in known]
            want += [known[tuple(text[at : at + fit[0]])]] if fit else []
            at += fit[0] if fit else 1
        assert licences.identifiers(text) == want


def test_edit_trees():
    enc, r = tokens.encoder(), random.Random(7)
    parts = ["ab", "c", " ", "é", ".", "\n", "12", ",", "'s", "  ", "漢", "字", "。", "\t", "<|endoftext|>", "<|", "endoftext", "|>", "x" * 30]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 120)))
        tree = editcount.Tree.of(text, enc, leaf=r.choice([1, 5, 40]))
        assert tree.text() == text and tree.total == len(enc.ids(text))
        for _ in range(8):
            a, b = r.randint(0, len(text) + 2), r.choice([0, 3, 60])
            new = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 3, 40])))
            tree.edit(a, a + b, new)
            text = text[:a] + new + text[a + b :]
            assert tree.text() == text and tree.total == len(enc.exact.encode(text, add_special_tokens=False).ids)


def test_edits_cost_what_they_touch():
    enc = tokens.encoder()
    text = "some words of prose, " * 2500
    tree = editcount.Tree.of(text, enc)
    for k in range(1500):
        tree.edit(30 * k, 30 * k + 2, "zz")
    assert tree.encoded <= 1500 * 2 * (editcount.LEAF + 40) and tree.total == len(enc.ids(tree.text()))
    assert max(len(x) for x, _ in tree.leaves()) < 3 * editcount.LEAF
    cjk = editcount.Tree.of("漢字漢字、" * 4000, enc)
    cjk.edit(7000, 7002, "語")
    assert len(cjk.leaves()) > 40 and cjk.encoded < 2000
    start = time.perf_counter()
    for run in ("a" * 400_000, "1 " * 200_000, "a.b@" * 100_000, "1(((((((2" * 50_000, "A1" * 200_000):
        editcount.redactions(run)
    assert time.perf_counter() - start < 5


def test_trees_are_kept(spark, texts):
    enc = tokens.encoder()
    trees = editcount.build_trees(table(spark, texts))
    for r in trees.collect():
        t = texts[r["doc_id"]]
        assert (r["leaf_chars"], r["leaf_tokens"]) == ((None, None) if t is None else ([len(x) for x in editcount.split(t)], [len(enc.ids(x)) for x in editcount.split(t)]))
    once = editcount.apply_edits(trees, lambda t: [(0, 1, "one ")])
    twice = editcount.apply_edits(once.select("doc_id", "text", "leaf_chars", "leaf_tokens"), lambda t: [(2, 3, " two")])
    for r in twice.collect():
        t = texts[r["doc_id"]]
        if t:
            a = "one " + t[1:]
            want = a[:2] + " two" + a[3:]
            assert r["text"] == want and r["n_tokens"] == len(enc.ids(a)) and r["n_tokens_edited"] == sum(r["leaf_tokens"]) == len(enc.ids(want))


def test_counts_and_empty_tables(spark, texts):
    enc = tokens.encoder()
    docs = table(spark, [*texts, "mail a.b@mail1.example.com now, call 4041894974608795"])
    for r in editcount.count_tokens(docs).collect():
        text = ([*texts, "mail a.b@mail1.example.com now, call 4041894974608795"])[r["doc_id"]]
        assert r["n_tokens"] == len(enc.ids(text or "")) and r["n_tokens_edited"] == len(enc.ids(r["edited"] or ""))
    none = table(spark, texts).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (suffix.repeated_spans(none), simhash.near_duplicates(none), rules.judge(none), packing.pack_documents(none), shards.training_order(none), decontam.find_leaks(none, bench), langid.identify(none), ordinal.grade_documents(none, labels), licences.scan_licences(none), editcount.count_tokens(none)):
        assert out.count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (None, "x " * 200)], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert (4, 4) in got and (None, 4) in got
    assert suffix.repeated_spans(docs).count() == 4 and packing.pack_documents(docs).count() == 4


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
        assert docs.count() <= n
        n = docs.count()
    assert 0.5 * 200 < n < 200
    packed = corpus_pipeline.run(spark, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_near_copies(spark, monkeypatch):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    r, docs = random.Random(12), []
    for _ in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(60, 160))]
        for n in (0, 0, 1, 1, 2, 3, 4, 6):
            t = list(base)
            for _ in range(n):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            docs.append(" ".join(t))
    docs += ["a b", "A  b", None, "", "c"]
    r.shuffle(docs)
    own, root = [shingles(t) for t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both, every = len(own[i] & own[j]), len(own[i] | own[j])
            if 5 * both >= 4 * every and root[i] != root[j]:
                a, b = min(root[i], root[j]), max(root[i], root[j])
                root = [a if x == b else x for x in root]
    assert 12 < len(set(root)) < 60
    import corpus_pipeline

    for block in (1024, 3):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        kept = corpus_pipeline.simhash_dedup(spark, table(spark, docs), None)
        assert kept.columns == table(spark, docs).columns
        assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(root))
    assert corpus_pipeline.simhash_dedup(spark, table(spark, docs).limit(0), None).count() == 0


def test_stages_keep_apart_documents_without_ids(spark):
    import corpus_pipeline

    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, bad = words(60), words(60), words(60), "too short"
    leak = words(20).capitalize() + ". " + words(8) + "."
    schema = "doc_id long, text string, lang string, source string"
    make = lambda rows: spark.createDataFrame([(i, t, "en", "s") for i, t in rows], schema)
    rows = [(None, a), (None, a), (None, b), (None, bad), (None, leak), (5, c), (5, bad), (5, leak), (6, a)]
    docs = make(rows)
    seen = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=str)
    good = [x for x in rows if x[1] != bad]
    left = rules.drop_low_quality(docs)
    assert left.columns == docs.columns and seen(left) == sorted(good, key=str)
    want = sorted([(6, a), (None, b), (None, bad), (None, leak), (5, c), (5, bad), (5, leak)], key=str)
    one = lambda found: sorted(t for _, t in found)
    for drop in (simhash.drop_near_duplicates, corpus_pipeline.jaccard.drop_near_copies):
        left = drop(docs)
        assert left.columns == docs.columns
        assert one(seen(left)) == sorted([a, b, c, bad, leak]) and set(seen(left)) <= set(want)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    assert seen(decontam.drop_leaks(docs, bench)) == sorted([x for x in rows if x[1] != leak], key=str)


def test_licence_query_equals_scan(spark):
    wraps = ["\n", "  ", "\t", "\n# ", " \n// ", " ", ", "]
    notices = [s.replace(" ", w) for _, s in licences.SENTENCES[::3] for w in wraps] + [s.upper() for _, s in licences.SENTENCES]
    texts = [f"Some prose.\n\n{n}\n\nMore prose." for n in notices] + EDGE
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in licences.scan_licences(table(spark, texts)).collect()}
    assert got == {i: licences.scan(t) for i, t in enumerate(texts)}
    assert licences.scan("All rights\nreserved.")[1] == ["Proprietary"]


def test_rules_equal_brute_force(spark):
    """Verdicts against the method in numpy over all rows: groups, starts, concentration until settled, distances."""
    import pandas as pd

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 == 0, "rare").when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    least = 60
    got = {r["doc_id"]: r for r in rules.verdicts(docs, least).collect()}
    own = rules.with_features(rules.document_statistics(docs)).withColumns({"base_failed": rules.base_failed(), "_order": F.xxhash64("doc_id", *rules.STATS)}).toPandas()
    fit = own[~own.base_failed]

    def estimate(rows):
        x = rows[rules.FEATURES].to_numpy(float)
        h = max(1, int(rules.SHARE * len(x)))
        sample = rows.sort_values(["_order", *rules.FEATURES])[: rules.SAMPLE][rules.FEATURES].to_numpy(float)
        found = []
        for _, mu, cov in rules.small_mcd(sample):
            det = np.inf
            while True:
                bins = np.floor(np.log2(np.maximum(rules.distances(x, mu, cov), 2.0**-20)) * 64)
                near = x[bins <= np.sort(bins)[h - 1]]
                new = rules.scatter(near)
                now = np.linalg.slogdet(new[1])[1]
                if not now < det - 1e-9:
                    break
                (mu, cov), det = new, now
            found.append((det, mu, cov))
        return min(found, key=lambda f: f[0])[1:]

    seen = set()
    for (lang, source), rows in own.groupby(["lang", "source"]):
        inner, outer = fit[(fit.lang == lang) & (fit.source == source)], fit[fit.lang == lang]
        base = inner if len(inner) >= least else outer if len(outer) >= least else fit
        seen.add(len(inner) >= least)
        mu, cov = estimate(base)
        d = rules.distances(rows[rules.FEATURES].to_numpy(float), mu, cov)
        for i, failed, x in zip(rows.doc_id, rows.base_failed, d):
            assert got[i]["distance"] == pytest.approx(x, rel=1e-6, abs=1e-6)
            assert got[i]["kept"] == (not failed and x <= rules.CUTOFF)
    assert seen == {True, False} and isinstance(own, pd.DataFrame)


def test_repeated_ids_with_different_texts(spark):
    """Two texts of one id are two documents, in the order of their hash; the same row twice gets the same answer twice."""
    r = random.Random(33)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c = words(40), words(40), words(40)
    rows = [(1, a + " " + c), (1, b + " " + c), (1, b + " " + c), (None, a), (None, c), (2, b)]
    docs = spark.createDataFrame([(*x, 7, "k") for x in rows], "doc_id long, text string, key int, part string")
    got = sorted((x["doc_id"], bytes(x["kept"]).decode()) for x in suffix.repeated_spans(docs.where("doc_id is not null")).collect())
    hashed = {x["text"]: x["h"] for x in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    first, second = sorted([a + " " + c, b + " " + c], key=hashed.get)
    rest = second[: len(second) - len(c) - 1]  # the tail with its blank starts earlier in the first text
    times = {b + " " + c: 2, a + " " + c: 1}
    assert got == sorted([(1, first)] * times[first] + [(1, rest)] * times[second] + [(2, "")])
    keyed = common.keyed(docs, "order").collect()
    place = {}
    for x in keyed:
        place.setdefault((x["doc_id"], x["text"]), set()).add(x["order"])
    assert all(len(v) == 1 for v in place.values()) and len({min(v) for v in place.values()}) == len(place) == 5
    assert max(min(v) for k, v in place.items() if k[0] is not None) < min(min(v) for k, v in place.items() if k[0] is None)
    left = suffix.drop_repeats(docs)
    assert left.columns == docs.columns and {(x["key"], x["part"]) for x in left.collect()} == {(7, "k")}


def test_stages_leave_columns_of_their_own_names_alone(spark):
    docs = spark.createDataFrame([(1, "some text of its own here", 5, 6, "q", 8), (2, "another text of its own there", 5, 6, "q", 8)], "doc_id long, text string, _key int, _hash int, _hit_hash string, lang int")
    bench = spark.createDataFrame([(1, "nothing of this is in there at all.")], "item_id long, text string")
    for out in (jaccard.drop_near_copies(docs), simhash.drop_near_duplicates(docs), decontam.drop_leaks(docs, bench)):
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_hot_fingerprints(spark, monkeypatch):
    texts = ["same words in all of these"] * 30 + [f"other words number {k} of them" for k in range(12)] + [None, ""]
    want = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    monkeypatch.setattr(simhash, "HOT_PARTS", 10**9)  # all are hot
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()} == want
    monkeypatch.setattr(simhash, "HOT_PARTS", 1)  # none is
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table(spark, texts)).collect()} == want


def test_unsettled_components_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.connected_components(path, max_rounds=2)


def test_scratch_tables_go(spark):
    with common.scratch():
        a = common.materialize(spark.range(3), "a")
        b = common.keep(a, "b")
        assert a.count() == 3
    assert b.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not_exist|no such"):
        spark.read.parquet(a._talkspan_path).count()


def test_packing_rows_without_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 4)
    docs = spark.createDataFrame([(None, "a b c d " * k) for k in range(1, 60)] * 2, "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    assert len(rows) >= 118 and all(r["doc_id"] is None for r in rows)
    bins = {}
    for r in rows:
        bins[r["sequence_id"]] = bins.get(r["sequence_id"], 0) + r["length"]
    assert max(bins.values()) <= packing.LIMIT

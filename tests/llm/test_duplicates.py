"""SimHash groups, fingerprints and line templates against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import alike, components, fingerprint, lines, neardup

WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
NO_ID = (1 << 63) - 1


def texts(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = rng.choices(WORDS, k=rng.randint(0, 60))
        out.append(" ".join(words))
        if rng.random() < 0.4:
            copy = list(words)
            if copy and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            out.append("\t".join(copy).upper() if rng.random() < 0.3 else " ".join(copy))
    return out


def brute_hash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def groups(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return [least[find(i)] for i in range(len(ids))]


def test_near_duplicates(frame):
    all_texts = texts(1) + [None, "", " \n", "one", "ONE", "ÉA b c"]
    docs = [(1000 - 3 * i, t) for i, t in enumerate(all_texts)] + [(None, all_texts[0]), (1000, all_texts[0])]
    fps = [brute_hash(t or "") for _, t in docs]
    expected = sorted((str(d), f"{f:016x}", g) for (d, _), f, g in zip(docs, fps, groups([d for d, _ in docs], fps, 4)))
    got = neardup.near_duplicates(frame(docs)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expected


def test_links_join_what_is_near(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PART", 40)  # buckets are dealt to cells
    rng = np.random.default_rng(2)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 6)]
    fps = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centre for _ in range(150)}
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    labels = {r.node: r.label for r in components.components(neardup.links(df)).collect()}
    unsigned = [f % (1 << 64) for f in signed]
    expected = groups(signed, unsigned, 4)
    assert [labels.get(f, f) for f in signed] == expected


def test_bit_planes_count_distances():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 130).astype(np.uint64)
    fps[64:] = fps[:66] ^ np.array([(1 << int(k)) - 1 for k in rng.integers(0, 12, 66)], np.uint64)
    planes = neardup.bit_planes(fps)
    for radius in (0, 3, 4, 7):
        got = neardup.near(fps, planes, 0, 130, radius)
        for i in range(130):
            bits = np.unpackbits(got[i].view(np.uint8), bitorder="little")[:130] if got is not None else np.zeros(130)
            assert [bool(b) for b in bits] == [j > i and (int(fps[i]) ^ int(fps[j])).bit_count() <= radius for j in range(130)]


def test_one_of_each(frame):
    docs = [(5, "a b c d e"), (2, "A b c d e"), (2, "A b c d e"), (9, "other words stand here now"), (None, None), (7, "")]
    kept = alike.one_of_each(frame(docs))
    assert kept.columns == frame(docs).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == [
        ("2", "A b c d e"), ("9", "other words stand here now")]
    assert neardup.near_duplicates(frame([])).count() == 0


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_alike_groups(ids, texts):
    """The smallest id that each row reaches by links of a Jaccard similarity of 0.8 and more, all pairs compared."""
    sets = [brute_set(t) for t in texts]
    label = list(range(len(ids)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return [min(ids[j] for j in range(len(ids)) if label[j] == x) for x in label]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = rng.choice(WORDS)
    return " ".join(out)


@pytest.mark.parametrize("small", [False, True])
def test_one_of_each_against_all_pairs(frame, monkeypatch, small):
    if small:  # buckets and candidate groups are dealt to cells
        monkeypatch.setattr(alike, "PART", 6)
        monkeypatch.setattr(alike, "SHINGLES", 700)
    rng = random.Random(11)
    texts = []
    for edits in [0, 1, 2, 3, 4, 5, 6, 8, 12] * 4:
        words = rng.choices(WORDS, k=rng.randint(100, 300))
        texts += [" ".join(words), *[edited(rng, words, edits) for _ in range(4)]]
    texts += ["", None, " \n", "one", "ONE", "one two", "a b c d e f g h i", "a b c d e f g h", "z b c d e f g h"]
    order = rng.sample(range(len(texts)), len(texts))
    docs = [(i, texts[k]) for i, k in enumerate(order)]
    ids = [i for i, _ in docs]
    want = {i for i, g in zip(ids, brute_alike_groups(ids, [t or "" for _, t in docs])) if i == g}
    got = {r.doc_id for r in alike.one_of_each(frame(docs)).collect()}
    assert want <= got  # nothing goes that has no near-duplicate
    assert len(got - want) <= 0.05 * (len(docs) - len(want))


def test_alike_joins_what_is_similar():
    rng = np.random.default_rng(12)
    base = rng.integers(0, 1 << 62, (5, 200)).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(200) < p, rng.integers(0, 1 << 62, 200).astype(np.uint64), b))
            for b in base for p in (0, 0.05, 0.1, 0.15, 0.3) for _ in range(12)]
    fps = np.array([alike.wide_simhash(s) for s in sets])
    label = list(range(len(sets)))
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    for i, j in alike.alike(fps, sets, 0.8, alike.RADIUS):
        assert jaccard(i, j) >= 0.8
        label = [label[i] if x == label[j] else x for x in label]
    lost = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] != label[j] and jaccard(i, j) >= 0.8]
    assert len(lost) <= 3
    far = [(int(x) ^ int(y)).bit_count() for x, y in zip(fps[0], fps[-1])]
    assert sum(far) > alike.RADIUS


def test_one_of_each_with_very_long_texts(frame):
    rng = random.Random(13)
    words = rng.choices(WORDS, k=120_000)
    docs = [(1, " ".join(words)), (2, edited(rng, words, 500)), (3, edited(rng, words, 60_000)), (4, " ".join(words[:3000]))]
    assert {r.doc_id for r in alike.one_of_each(frame(docs)).collect()} == {1, 3, 4}
    assert alike.one_of_each(frame([])).count() == 0


def brute_pairs(docs):
    rows = sorted(docs, key=lambda d: (-(1 << 63) if d[0] is None else d[0]), reverse=True)
    out = {}
    for (i, t), (_, nxt) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        half = len(t) // 2
        out[i] = (len(t), hashlib.sha256((t[:len(t) - half] + nxt[:half]).encode()).hexdigest())
    return out


def test_fingerprints_of_edited_texts(frame):
    rng = random.Random(4)
    docs = [(i * i, " ".join(rng.choices(WORDS, k=rng.choice([1, 30, 80]))) + "é😀") for i in range(60)]
    docs += [(-5, None), (-9, ""), (None, "last of all"), (70_000, "word " * 70_000)]
    got = fingerprint.fingerprint_pairs(frame(docs)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute_pairs(docs) and len(got) == len(docs)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    order = sorted(got, key=lambda r: -(1 << 63) if r.doc_id is None else r.doc_id, reverse=True)
    for r, nxt in zip(order, order[1:] + order[:1]):
        a, b, c = int(r.fingerprint, 16), int(r.edited_fingerprint, 16), int(nxt.fingerprint, 16)
        assert abs(r.near_edited - (1 - (a ^ b).bit_count() / 128)) < 1e-12
        assert abs(r.near_next - (1 - (a ^ c).bit_count() / 128)) < 1e-12
    long = [r for r in got if r.n_chars > 200 and r.doc_id != 70_000]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.9


def test_fingerprint_edges(frame):
    assert fingerprint.fingerprint_pairs(frame([])).count() == 0
    one = fingerprint.fingerprint_pairs(frame([(1, "abcdef")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one[0].near_next == 1
    same = fingerprint.fingerprint_pairs(frame([(1, "same text"), (1, "same text"), (2, "same text")])).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1


def brute_votes(text):
    """128 bits of word pairs: each bit by the majority of the terms' hashes."""
    words = re.split(r"[ \t\n\x0b\f\r]+", (text or "").strip(" \t\n\r\f\v").lower())
    terms = list(zip(["", *words], [*words, None]))
    h = [xxhash.xxh64_intdigest(a.encode(), 42) for a, _ in terms]
    h = [x if b is None else xxhash.xxh64_intdigest(b.encode(), x) for x, (_, b) in zip(h, terms)]
    g = [xxhash.xxh64_intdigest(x.to_bytes(8, "little"), 42) for x in h]
    return sum(1 << b + shift for shift, hs in ((64, h), (0, g)) for b in range(64) if 2 * sum(x >> b & 1 for x in hs) > len(hs))


def test_fingerprints_links_and_classes_by_brute_force(frame, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_OF_BUCKET", 8)  # buckets are dealt to cells
    rng = random.Random(9)
    docs = []
    for i in range(30):
        words = rng.choices(WORDS, k=400)
        docs.append((1000 - i, " ".join(words)))
        for j in range(rng.randint(0, 3)):
            docs.append((2000 + 10 * i + j, " ".join([*words[:390 + 3 * j], *rng.choices(WORDS, k=rng.randint(0, 2))])))
    base = rng.choices(WORDS, k=3000)
    docs += [(5000 + i, " ".join([*base, *rng.choices(WORDS, k=1)])) for i in range(60)]
    docs += [(None, "copied text without an id")] * 40 + [(None, docs[0][1]), (1000, docs[0][1]), (7, None), (8, ""), (8, "")]
    docs.append((90, "é Straße\u3000x\ty  z\x0b" + "long " * 40_000))
    got = fingerprint.fingerprint_pairs(frame(docs)).collect()
    fps = [brute_votes(t) for _, t in docs]
    least = {}
    for (i, _), f in zip(docs, fps):
        least[f] = min((x for x in (least.get(f), i) if x is not None), default=None)
    links = [sum((f ^ g).bit_count() <= fingerprint.RADIUS for g in fps) - 1 for f in fps]
    assert max(links) > 40 and any(0 < n < 5 for n in links)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.class_id), r.links) for r in got) == sorted(
        (str(i), f"{f:032x}", str(least[f]), n) for (i, _), f, n in zip(docs, fps, links))


def test_fingerprint_tables_are_not_broadcast(frame, spark, monkeypatch):
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # small files are broadcast
    written, write = {}, fingerprint.write_through
    monkeypatch.setattr(fingerprint, "write_through", lambda df, name: written.update({name: df}) or write(df, name))
    got = fingerprint.fingerprint_pairs(frame([(i, f"text {i % 7} " * 30) for i in range(40)]))
    assert set(written) == {"fingerprints", "classes", "buckets"}
    for df in (written["classes"], written["buckets"], got):
        planned = df._jdf.queryExecution().executedPlan()
        assert "Broadcast" not in planned.toString()
        df.collect()
        assert "Broadcast" not in planned.toString()  # as it ran
    assert "SortMergeJoin" in planned.toString()


def test_slices_of_a_hot_id(spark):
    rows = spark.createDataFrame([(-(1 << 63) if i % 3 else i, f"text {i}") for i in range(3000)], "id long, text string")
    dealt = fingerprint.sliced(rows, 30).collect()
    sizes = {}
    for r in dealt:
        sizes[r["slice"]] = sizes.get(r["slice"], 0) + 1
    assert max(sizes.values()) < 300
    spans = {}
    for r in dealt:
        spans.setdefault(r["slice"], []).append(r["id"])
    by_slice = [spans[k] for k in sorted(spans)]
    assert all(min(a) >= max(b) for a, b in zip(by_slice, by_slice[1:]))


@pytest.mark.parametrize("radius, blocks", [(3, None), (6, None), (3, 6)])
def test_near_pairs_within_the_radius(spark, monkeypatch, radius, blocks):
    monkeypatch.setattr(fingerprint, "PART_OF_BUCKET", 16)
    rng = np.random.default_rng(5)
    base = [int(x) << 64 | int(y) for x, y in rng.integers(0, 1 << 63, (40, 2))]
    base += base[:1] * 30  # one wide group
    fps = base + [b ^ sum(1 << int(k) for k in rng.choice(128, rng.integers(0, 8), replace=False)) for b in base for _ in range(3)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(i, signed(f >> 64), signed(f & (1 << 64) - 1), i % 5) for i, f in enumerate(fps)],
                               "doc_id long, hi long, lo long, salt long")
    own = fingerprint.classes(df)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(f, i)
    assert {(r.class_id, r["size"]) for r in own.collect()} == {(i, fps.count(f)) for f, i in first.items()}
    pairs = [(min(r.a_class_id, r.b_class_id), max(r.a_class_id, r.b_class_id), r.distance)
             for r in fingerprint.near_pairs(own, radius, blocks).collect()]
    distinct = list(first.items())
    assert sorted(pairs) == sorted((min(i, j), max(i, j), (f ^ g).bit_count()) for a, (f, i) in enumerate(distinct)
                                   for g, j in distinct[:a] if (f ^ g).bit_count() <= radius)


HAN = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
                 "\U00020000-\U0003ffff])")


def brute_template(line):
    tokens = tuple(HAN.sub(r" \1 ", line).split())
    fields = sum(any(c.isdecimal() for c in t) for t in tokens)
    return tokens if 2 * fields > len(tokens) else tuple("<*>" if any(c.isdecimal() for c in t) else t for t in tokens)


def brute_alike(a, b):
    return a == b or len(a) == len(b) >= 5 and (a[:2] == b[:2] or a[-2:] == b[-2:]) \
        and 100 * sum(x == y for x, y in zip(a, b)) >= 80 * len(a)


def brute_lines(docs):
    """All lines against all templates of documents with smaller ids."""
    named = [(NO_ID if i is None else i, [] if t is None else t.split("\n")) for i, t in docs]
    ids = {}
    for i, ls in named:
        for line in ls:
            ids.setdefault(brute_template(line), set()).add(i)
    ids.pop((), None)
    out = []
    for (i, ls), (_, t) in zip(named, docs):
        kept, said = [], set()
        for line in ls:
            own, again = brute_template(line), tuple(HAN.sub(r" \1 ", line).split()) in said
            said.add(tuple(HAN.sub(r" \1 ", line).split()))
            near = set().union(*(ids[x] for x in ids if brute_alike(own, x))) if own else {i}
            if not own or min(near) == i and not (again and max(ids[own]) > i):
                kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_recurring_lines(frame):
    rng = random.Random(6)
    shared = [" ".join(rng.choices(WORDS, k=rng.randint(5, 40))) for _ in range(12)] + ["Copyright 2020 by some company here",
                                                                                     "short line"]
    docs = []
    for i in range(80):
        body = [" ".join(rng.choices(["alpha", *WORDS], k=rng.randint(1, 30))) for _ in range(rng.randint(0, 5))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            words = s.split()
            if rng.random() < 0.3:
                words[-1] = rng.choice(WORDS)
            if rng.random() < 0.3:
                words.insert(rng.randrange(len(words)), "more")
            body.insert(rng.randint(0, len(body)), " ".join(words).replace("2020", str(rng.randint(1990, 2030))))
        docs.append((i * 7 % 80, "\n".join(body)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (102, docs[1][1] + "\n" + docs[1][1]), (102, "x\n\n y"), (103, "\n\n")]
    got = lines.drop_recurring_lines(frame(docs)).collect()
    expected = sorted((str(i), str(t)) for (i, _), t in zip(docs, brute_lines(docs)))
    assert sorted((str(r.doc_id), str(r.text)) for r in got) == expected
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert lines.drop_recurring_lines(frame([])).count() == 0


def test_clashing_names(frame):
    docs = frame([(1, "a b c d e f"), (2, "a b c d e f")]).withColumns({"id": F.lit("mine"), "text_hash": F.lit("mine"),
                                                                        "line": F.lit(1)})
    rows = sorted(lines.drop_recurring_lines(docs).collect(), key=lambda r: r.doc_id)
    assert [r.text for r in rows] == ["a b c d e f", ""] and rows[0].id == rows[1].text_hash == "mine"
    found = alike.one_of_each(docs.withColumn("component_id", F.lit("mine")))
    assert found.count() == 1 and "component_id" in found.columns


def test_short_and_varied_lines_go(frame):
    rest = " ".join(f"t{chr(97 + i)}" for i in range(14))
    first, last = " ".join(rest.split()[1:]), " ".join(rest.split()[:-1])
    pairs = [("All rights reserved.", "All rights reserved."), ("版权所有不得转载", "版权所有不得转载"),
             ("本站内容由用户上传仅供学习参考", "本站内容由作者上传仅供学习参考"), ("one two three four five", "one two other four five"),
             (rest, "changed " + first), (rest, rest.replace("td", "x").replace("tm", "y")),
             ("Copyright 2020 by some company", "Copyright 2021 by some company"), ("1 2 3 4", "1 2 3 4")]
    for a, b in pairs:
        got = {r.doc_id: r.text for r in lines.drop_recurring_lines(frame([(1, a), (2, "own words\n" + b)])).collect()}
        assert got == {1: a, 2: "own words"}, b
    for a, b in [("12 34", "12 35"), ("red apples", "green apples"), ("1 2 3 4 5 6 a b c d", "1 2 3 4 5 6 w x y z"),
                 ("1 2 3 4 5 6", "2 3 4 5 6 7"), ("a b c d e f g h i j", "a b c x y z g h i j"),
                 (rest, "added " + rest), (rest, last), (rest, rest.replace("tb", "x").replace("tm", "y"))]:
        got = {r.doc_id: r.text for r in lines.drop_recurring_lines(frame([(1, a), (2, b)])).collect()}
        assert got == {1: a, 2: b}, b


def test_a_document_keeps_what_none_before_it_says(frame):
    words = " ".join(f"w{chr(97 + i)}" for i in range(12))
    many = "\n".join(words.replace("wf", f"x{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}") for i in range(100))
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(frame([(1, many), (2, many.replace("wa", "wz"))])).collect()}
    assert got == {1: many, 2: ""}


def test_large_leaves_are_dealt_to_cells(spark, monkeypatch):
    monkeypatch.setattr(lines, "PART", 4)
    rng = random.Random(8)
    rows = [(i, "same start " + " ".join(rng.choices("abcd", k=4))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(df).collect()}
    assert got == {i: t for (i, _), t in zip(rows, brute_lines(rows))}


def test_long_lines_and_documents(frame):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000))
    docs = [(1, long), (2, long.replace("wcc", "other", 3)), (3, "\n".join(["a b"] * 30_000)), (4, "a b\nc")]
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(frame(docs)).collect()}
    assert got == {1: long, 2: "", 3: "a b", 4: "c"}


def test_one_row_of_each_group_whatever_its_id(frame):
    docs = [(None, "a b c d e"), (None, "A b c d e"), (None, "quite another text without id"), (7, "first text of this id here"),
            (7, "something else under the same id"), (8, "SOMETHING else under the same id"), (None, "first text of this id here")]
    kept = alike.one_of_each(frame(docs)).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [
        ("7", "first text of this id here"), ("7", "something else under the same id"),
        ("None", "a b c d e"), ("None", "quite another text without id")]

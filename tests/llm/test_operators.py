"""Every query on hard rows and on empty tables, against plain versions of what it does."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

import corpus_pipeline
from quern.llm import imatch, katz, licenses, mixing, pieces, quality, registry, shingles, simhash, toxicity, unigram, vectors
from quern.llm.components import components

from .conftest import label_rows, rows
from .katz_model import Model

QUERIES = registry.queries()


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def got(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).toPandas()


def held(i, mod, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % mod == remainder


def number(x):
    return None if x is None or x != x else int(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert got(spark, empty_dir, name).empty


def test_empty_pipeline(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_katz(spark, sf_dir):
    every = [(r[0], r[1]) for r in rows()]
    model = Model(every)
    for h in model.back:
        assert math.isclose(sum(model.p(w, h) for w in model.c1) + model.p(None, h), 1, rel_tol=1e-9)
    found = sorted((number(r.doc_id) or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got(spark, sf_dir, "op1_katz").itertuples())
    expected = sorted((i or 0, held(i, 7, 2), n, k, model.n, round(base, 6), round(score, 6)) for i, t in every for n, k, base, score in [model.score(t)])
    assert len(found) == len(expected)
    for a, b in zip(found, expected):
        assert a[:5] == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-7, atol=2e-5)


def test_katz_spreads_frequent_contexts(spark, sf_dir, monkeypatch):
    """Chunks of a few tokens, and contexts that many owners share, give the same scores."""
    whole = got(spark, sf_dir, "op1_katz").sort_values(["n_tokens", "score"])["score"].to_numpy()
    monkeypatch.setattr(katz, "SHARE", 2000)
    again = got(spark, sf_dir, "op1_katz").sort_values(["n_tokens", "score"])["score"].to_numpy()
    assert np.allclose(whole, again)


def test_pieces(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_file=registry.MODEL)
    expected = set()
    for i, t, *_ in rows():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        expected.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert {(number(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got(spark, sf_dir, "op2_pieces").itertuples()} == expected


def test_pieces_round_trip(spark, docs):
    found = pieces.encode_decode(docs, registry.MODEL, ["doc_id", "text"]).toPandas()
    for r in found.itertuples():
        assert r.decoded == (r.text or "").replace("▁", " ")


def test_toxicity(spark, sf_dir):
    found = got(spark, sf_dir, "op3_toxicity")
    assert len(found) == len(rows())
    assert found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= 0.5)).all()
    for r in found.itertuples():
        assert r.held_out == held(number(r.doc_id), 5, 0)


def test_toxicity_learns():
    draw = np.random.default_rng(1)
    words = [f"word{i}" for i in range(300)]
    y = draw.integers(0, 2, 600)
    texts = [" ".join(draw.choice(words, 30)) + (" vile thing" if k else "") for k in y]
    doc, feature = toxicity.features(toxicity.pa.array(texts))
    ends = np.searchsorted(doc, np.arange(601))
    examples = [feature[a:b] for a, b in zip(ends, ends[1:])]
    kept, w = toxicity.train(examples[:400], y[:400])
    dense = np.zeros(toxicity.SPACE + 1)
    dense[kept] = w
    score = np.array([dense[e].sum() + dense[-1] for e in examples[400:]])
    assert ((score >= 0) == y[400:]).mean() > 0.97
    assert len(kept) < 200  # L1 leaves few


def test_mixing(spark, sf_dir):
    found = got(spark, sf_dir, "op4_mixing")
    assert len(found) == len(rows())
    assert found["probability"].between(0, 1).all()
    assert math.isclose((found["n_tokens"] * found["probability"]).sum(), mixing.BUDGET * found["n_tokens"].sum(), rel_tol=1e-5)
    by_id = found.dropna(subset="doc_id").groupby("doc_id")["selected"].nunique()
    assert by_id.drop([5, 7], errors="ignore").eq(1).all()


def test_rake_meets_marginals():
    draw = np.random.default_rng(2)
    keys = [draw.integers(0, 4, 50), draw.integers(0, 3, 50)]
    tokens = draw.integers(1, 100, 50).astype(float)
    targets = [np.full(4, tokens.sum() / 10), tokens.sum() * 0.4 * np.array([0.5, 0.3, 0.2])]
    x, off = mixing.rake(keys, tokens, targets, tokens * 0.4)
    assert off < mixing.TOLERANCE and (x <= tokens).all() and (x >= 0).all()
    for key, target in zip(keys, targets):
        assert np.allclose(np.bincount(key, x, minlength=len(target)), target, rtol=1e-4)


def test_goals():
    assert mixing.goals({"a": 60, "b": 30, "c": 10}, 0.5, None, 1.0) == pytest.approx({"a": 30, "b": 15, "c": 5})
    assert mixing.goals({"a": 60, "b": 30, "c": 10}, 0.5, {"a": 0.2}, 1.0) == pytest.approx({"a": 10, "b": 30, "c": 10})  # what b and c can't give goes back
    assert mixing.goals({"a": 60, "b": 30, "c": 0, None: 10}, 0.5, {"b": 0.4, "no": 0.3}, 0.0) == pytest.approx({"a": 120 / 7, "b": 160 / 7, "c": 0, None: 10})
    with pytest.raises(ValueError):
        mixing.goals({"a": 1}, 0.5, {"a": 1.5}, 1.0)


def dense_cells(spark):
    draw = random.Random(8)
    return spark.createDataFrame([(s, lang, topic, draw.randint(50, 2000)) for s in ("a", "b", None, "d") for lang in ("en", "de", None) for topic in (-1, 0, 5)] + [("e", "en", 0, 0)], "source string, lang string, topic int, n_tokens long")


@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.5, "de": 0.1}, "source": {"d": 0.05}}])
def test_mixing_meets_its_targets(spark, targets):
    """The marginals of the expected tokens against a plain reading of the targets, with the constants in use."""
    found = [r.asDict() for r in dense_cells(spark).join(mixing.chances(dense_cells(spark), 0.4, targets)[0].withColumnsRenamed({c: "c_" + c for c in mixing.DIMENSIONS}), mixing.F.expr("source <=> c_source AND lang <=> c_lang AND topic <=> c_topic")).collect()]
    assert len(found) == 37 and all(0 <= r["probability"] <= 1 for r in found)
    total = sum(r["n_tokens"] for r in found)
    for c in mixing.DIMENSIONS:
        own = {v: sum(r["n_tokens"] for r in found if r[c] == v) for v in {r[c] for r in found}}
        flat = {v: (t / total) ** mixing.FLATTEN[c] if t else 0 for v, t in own.items()}
        given = (targets or {}).get(c, {})
        rest = sum(x for v, x in flat.items() if v not in given)
        for v in own:
            share = given.get(v, flat[v] / rest * (1 - sum(given.values())))
            assert sum(r["n_tokens"] * r["probability"] for r in found if r[c] == v) == pytest.approx(0.4 * total * share, rel=1e-4, abs=0.01)


def test_raking_as_tables_agrees(spark):
    targets = {"lang": {"en": 0.5}}
    small, large = mixing.chances(dense_cells(spark), 0.4, targets), mixing.chances(dense_cells(spark), 0.4, targets, driver_cells=0)
    a, b = ({(r["source"], r["lang"], r["topic"]): r for r in x.collect()} for x, _ in (small, large))
    assert a.keys() == b.keys()
    assert all(abs(a[k]["probability"] - b[k]["probability"]) < 1e-9 for k in a)


def test_goals_as_a_table_agree(spark, monkeypatch):
    cells = spark.createDataFrame([(f"s{i}", 10 + i * i % 97) for i in range(1200)], "source string, tokens long")
    given = {"s3": 0.001, "s5": 0.2}
    found = {r["k"]: r["goal"] for r in mixing._goal_table(cells, "source", 0.5, given, 0.5, 0).collect()}
    assert found == pytest.approx(mixing.goals({f"s{i}": 10 + i * i % 97 for i in range(1200)}, 0.5, given, 0.5), rel=1e-9)


def test_targets_that_cannot_be_met_are_told(spark):
    rows_ = spark.createDataFrame([("a", "en", 0, 100), ("b", "de", 0, 100)], "source string, lang string, topic int, n_tokens long")
    with pytest.warns(UserWarning, match="missed"):
        mixing.chances(rows_, 0.4, {"source": {"a": 0.9}, "lang": {"en": 0.1}})


def test_licenses(spark, sf_dir):
    found = {(number(r.doc_id), r.n_words, r.n_base, number(r.first_word), number(r.last_word), r.base_labels) for r in got(spark, sf_dir, "op5_licenses").itertuples()}
    expected = set()
    for i, t, *_ in rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        expected.add((i, len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert found == expected


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def every_span(joined, phrase, most):
    """(edits, start, end) of all stretches of whole words within the notice's edits."""
    borders = [0, *(i + 1 for i, c in enumerate(joined) if c == " ")]
    ends = [i for i, c in enumerate(joined) if c == " "] + [len(joined)]
    return [(n, a, b) for a in borders for b in ends if abs(b - a - len(phrase)) <= most and (n := edits_between(joined[a:b], phrase)) <= most]


def test_licenses_with_edits():
    for text, expected in (
        (b"x Permision is hereby granted, free of charge y", [("permision is hereby granted free of charge", "mit", 1)]),
        (b"mozila publc license mozilla public license", [("mozila publc license", "mpl", 2), ("mozilla public license", "mpl", 0)]),
        (b"the mit licence the mit license", [("the mit licence", "mit", 1), ("the mit license", "mit", 0)]),
        (b"genral publik license general public license", [("genral publik license", "gpl", 2), ("general public license", "gpl", 0)]),
        (b"all rights resrved all rights reserved", [("all rights resrved", "reserved", 1), ("all rights reserved", "reserved", 0)]),
        (b"nothing of the kind", []),
    ):
        _, spans, joined = licenses.Scanner().scan(text)
        assert [(joined[a:b], label, edits) for a, b, label, edits, base in spans if not base] == expected


def test_licenses_find_what_a_full_search_finds():
    """Every stretch within a notice's edits is a span or overlaps one of no more edits; spans are right and don't overlap."""
    draw, scanner = random.Random(21), licenses.Scanner()
    for _ in range(150):
        parts = []
        for _ in range(draw.randint(1, 4)):
            phrase, _, most = draw.choice(licenses.NOTICES)
            letters = list(phrase)
            for _ in range(draw.randint(0, most + 1)):
                at = draw.randrange(len(letters))
                letters[at : at + draw.choice((0, 1))] = draw.choice(("", "x", "e", " "))
            parts += ["".join(letters), draw.choice(("", "and", "license", "the"))]
        _, spans, joined = scanner.scan(" ".join(parts).encode())
        for k, (phrase, label, most) in enumerate(licenses.NOTICES):
            windows = every_span(joined, phrase, most)
            mine = scanner.verified(len(licenses.BASE) + k, joined, {(0, len(joined))}) if windows else []
            kept = [(a, b, n) for a, b, name, n, base in spans if name == label and not base]
            for n, a, b in windows:
                assert any(s < b and a < e and edits <= n for s, e, edits in kept), (joined, phrase, joined[a:b])
            for a, b, n in mine:
                assert edits_between(joined[a:b], phrase) <= n <= most
        for a, b, label, n, base in spans:
            assert base or any(edits_between(joined[a:b], phrase) <= n <= most for phrase, name, most in licenses.NOTICES if name == label)


def test_licenses_query_labels_and_score(spark, sf_dir):
    found = {(number(r.doc_id), r.labels, round(r.score, 9)) for r in got(spark, sf_dir, "op5_licenses").itertuples()}
    expected = set()
    for i, t, *_ in rows():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
        joined, hits = " ".join(words), []
        if len(joined) < 2000:
            for phrase, label, most in licenses.NOTICES:
                hits += [(label, 1 - 3 * n / (b - a)) for n, a, b in every_span(joined, phrase, most)]
            hits += [(label, 1.0) for phrase, label in licenses.BASE.items() if f" {phrase} " in f" {joined} "]
        expected.add((i, ",".join(sorted({h[0] for h in hits})), round(max([h[1] for h in hits], default=0.0), 9)))
    assert {f[:2] for f in found} == {e[:2] for e in expected}
    assert {f[::2] for f in found} == {e[::2] for e in expected}


def plain_prints(texts, terms):
    """I-Match by its definition: sorted terms of every random subset, hashed."""
    def mixed64(x):
        return int(imatch.mix(np.array([x], dtype=np.uint64))[0])

    out = []
    for t in texts:
        every = sorted({int(h) for h in imatch.batch_words(imatch.pa.array([t]))[0]})
        used = [h for h in every if h in terms] or every
        row = [0] * (imatch.SUBSETS * imatch.RATES)
        for k in range(imatch.SUBSETS):
            mark = mixed64(k + 1)
            for r in range(imatch.RATES):
                most = (1 << 64) // imatch.RATE**r - (r == 0)
                inside = [v for h in used if (v := mixed64(h ^ mark)) < most]
                if inside:
                    total = sum(mixed64((mixed64(v) + place) & (2**64 - 1)) for place, v in enumerate(inside)) & (2**64 - 1)
                    row[k * imatch.RATES + r] = (mixed64(total) >> 48) | 1
        out.append((row, len(used)))
    return out


def plain_likeness(a, b):
    (x, n), (y, m) = a, b
    if x == y:
        return 1.0
    rate = min(imatch.RATES - 1, max(0, round(math.log(max(1, n, m) / 1.5) / math.log(imatch.RATE))))
    pairs = [(x[k * imatch.RATES + rate], y[k * imatch.RATES + rate]) for k in range(imatch.SUBSETS)]
    some = [p for p in pairs if any(p)]
    return sum(p == q for p, q in some) / len(some) if some else 0.0


def test_imatch_by_its_definition(spark, sf_dir):
    every = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows()))
    texts = [t for _, _, t in every]
    counts = {}
    for t in texts:
        for h in set(imatch.batch_words(imatch.pa.array([t]))[0].tolist()):
            counts[h] = counts.get(h, 0) + 1
    least, most = max(imatch.LEAST_DOCS, imatch.LEAST_SHARE * len(texts)), max(imatch.LEAST_DOCS, imatch.MOST_SHARE * len(texts))
    terms = {h for h, n in counts.items() if least <= n <= most}
    following = [*texts[1:], texts[0]]
    own, new = plain_prints(texts, terms), plain_prints([t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)], terms)
    expected = sorted((i if known else 0, imatch.text_of(np.array(a[0], np.uint16)), imatch.text_of(np.array(n[0], np.uint16)), round(plain_likeness(a, n), 9), round(plain_likeness(a, b), 9)) for (known, i, _), a, b, n in zip(every, own, [*own[1:], own[0]], new))
    found = sorted((number(r.doc_id) or 0, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got(spark, sf_dir, "op6_imatch").itertuples())
    assert found == expected


def test_imatch(spark, sf_dir):
    found = got(spark, sf_dir, "op6_imatch")
    every = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in rows()))
    texts = [t for _, _, t in every]
    expected = sorted((i if known else None or 0, len(t), hashlib.sha256(imatch.edited(t, f).encode()).hexdigest()) for (known, i, t), f in zip(every, [*texts[1:], texts[0]]))
    assert sorted((number(r.doc_id) or 0, r.n_chars, r.edited_sha256) for r in found.itertuples()) == sorted((i or 0, n, h) for i, n, h in expected)
    assert found["near_edited"].between(0, 1).all() and found["near_next"].between(0, 1).all()
    prints = found.set_index("doc_id")["fingerprint"]
    assert prints[10] == prints[11] == prints[12] != prints[20]


def test_unigram(spark, sf_dir):
    scores = unigram.vocabulary(open(registry.MODEL, "rb").read())
    byte = min(scores.values()) - 10

    def count(word):  # plain forward search over one word
        text = "▁" + word
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            options = [(best[s][0] + scores[text[s:end]], -best[s][1] - 1) for s in range(max(0, end - 64), end) if text[s:end] in scores]
            if options:
                score, n = max(options)
                best[end] = score, -n
            else:
                size = len(text[end - 1].encode())
                best[end] = best[end - 1][0] + byte * size, best[end - 1][1] + size
        return best[-1][1]

    found = {(number(r.doc_id), r.n_words, r.n_tokens) for r in got(spark, sf_dir, "op7_unigram").itertuples()}
    known = {w: count(w) for r in rows() for w in set((r[1] or "").split())}
    assert found == {(i, len((t or "").split()), sum(known[w] for w in (t or "").split())) for i, t, *_ in rows()}


def test_unigram_bounds(monkeypatch):
    """Long words, texts cut in portions and memos that are full count as everything at once does."""
    scores = unigram.vocabulary(open(registry.MODEL, "rb").read())
    texts = ["", " \x1c ", *[" ".join(r[1].split()[:3000]) if r[1] else "" for r in rows()], "the日本" * 5000 + " the stone " * 200, "a\u3000b\x85c the"]
    plain = unigram.Counter(scores)
    known = plain.walk({w for t in texts for w in t.split()})
    expected = [len(t.split()) for t in texts], [sum(known[w] for w in t.split()) for t in texts]
    for name, value in (("LONG", 7), ("PIECE", 50), ("WORDS", 3), ("STEP", 5), ("MEMO", 2000)):
        monkeypatch.setattr(unigram, name, value)
        small = unigram.Counter(scores)
        assert small.totals(texts) == expected
    assert small.size <= 2000 + 50 * 200 and all(len(w) <= 7 for w in small.memo | small.old)


def test_quality(spark, sf_dir):
    found = got(spark, sf_dir, "op8_quality")
    assert len(found) == len(rows())
    assert found["score"].between(0, 1).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all()


def test_quality_rules_compile(spark):
    draw = np.random.default_rng(0)
    x = draw.random((3000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    z = sum((quality.holds(r, x) * w for r, w in zip(model[0], model[1])), np.full(len(x), model[2]))
    assert (((z > 0) == y)[2000:]).mean() > 0.97
    frame = spark.createDataFrame([(i, tuple(map(float, r))) for i, r in enumerate(x[:50])], "i int, stats struct<" + ",".join(f"{n}:double" for n in quality.NAMES) + ">")
    scores = [r[0] for r in frame.orderBy("i").select(quality.compiled(model)).collect()]
    assert np.allclose(scores, 1 / (1 + np.exp(-z[:50])))


def test_statistics_of_odd_texts():
    x = quality.statistics(quality.pa.array([None, "", "A b\nA b", "x" * 3_000_000, "a " * 2_000_000]))
    assert np.isfinite(x).all()
    assert x[0].tolist() == x[1].tolist() == [0.0] * len(quality.NAMES)
    of = dict(zip(quality.NAMES, x[2]))
    assert (of["n_words"], of["n_lines"], of["line_repeats"], of["distinct"], of["capitals"]) == (4, 2, 0.5, 0.5, 0.5)
    assert dict(zip(quality.NAMES, x[4]))["n_words"] == 2_000_000


def test_vectors(spark, sf_dir):
    table = {}
    for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect():
        v = r["embedding"]
        fine = bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        table[r["vec_id"]] = np.array(v, float) if fine and r["vec_id"] is not None else None
    table.pop(None)
    ids = sorted(table)

    def linked(a, b):
        a, b = table[a], table[b]
        if a is None or b is None or len(a) != len(b):
            return False
        a, b = a / abs(a).max(), b / abs(b).max()
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.95

    links = {a: [b for b in ids if b != a and linked(a, b)] for a in ids}
    component = {}
    for a in ids:
        todo = [a]
        while todo:
            if (b := todo.pop()) not in component:
                component[b] = component.get(a, a)
                todo += links[b]
    found = got(spark, sf_dir, "op9_vectors")
    assert {(number(r.vec_id), r.n_links, number(r.component_id)) for r in found.itertuples() if number(r.vec_id) is not None} == {(a, len(links[a]), component[a]) for a in ids}
    assert len(found) == len(ids) + 1
    assert all(r.kept == (r.vec_id == r.component_id) for r in found.itertuples() if number(r.vec_id) is not None)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(spark, sf_dir):
    found = got(spark, sf_dir, "op10_simhash")
    every = [(r[0], plain_fingerprint(r[1])) for r in rows()]
    assert sorted((number(r.doc_id) or 0, r.fingerprint) for r in found.itertuples()) == sorted((i or 0, f"{fp:016x}") for i, fp in every)
    group = list(range(len(every)))
    for _ in range(8):
        for a in range(len(every)):
            for b in range(len(every)):
                if None not in (every[a][0], every[b][0]) and ((every[a][1] ^ every[b][1]).bit_count() <= 4 or every[a][0] == every[b][0]):
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((every[k][0] for k in range(len(every)) if group[k] == g and every[k][0] is not None), default=None) for g in set(group)}
    expected = sorted((every[k][0], least[group[k]]) for k in range(len(every)) if every[k][0] is not None)
    assert sorted((number(r.doc_id), number(r.component_id)) for r in found.itertuples() if number(r.doc_id) is not None) == expected


def test_simhash_trees_find_all_pairs(spark):
    """Links over random and close fingerprints, enough to walk the trees' deeper levels."""
    draw = np.random.default_rng(4)
    base = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    near = base[:800].copy()
    for _ in range(3):
        near ^= np.uint64(1) << draw.integers(0, 64, len(near)).astype(np.uint64)
    chain = [base[0]]
    for b in range(40):
        chain.append(chain[-1] ^ np.uint64(0b101 << b))
    fps = np.unique(np.concatenate([base, near, np.array(chain, np.uint64)]))
    frame = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    found = {r["node"]: r["component"] for r in components(simhash.near_pairs(frame)).collect()}
    links = simhash.Links(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    links.join(a, b)
    assert [found.get(i, i) for i in range(len(fps))] == links.root.tolist()


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100)] + [(500, i) for i in range(300, 400)] + [(7, 7), (None, 3), (900, 800)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(101))
    assert found[500] == found[399] == 300 and found[900] == 800 and 7 in found


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == corpus_pipeline.COLUMNS
        rows_ = out.collect()
        assert {(r["doc_id"], r["text"]) for r in rows_} <= {(r["doc_id"], r["text"]) for r in kept.collect()}, name
        kept = spark.createDataFrame(rows_, out.schema)
    assert corpus_pipeline.run(spark, sf_dir).count() == kept.count()


def test_nothing_to_learn_from(spark, docs, sf_dir):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(toxicity.score(docs, toxicity.learn(docs, none), ["doc_id"]).toPandas()["score"]) == {0.5}
    assert quality.learn_from(docs, none)[2] == 0.0
    one = spark.createDataFrame([(r[0], 1, 0) for r in label_rows()], "doc_id long, quality int, toxic int")
    assert quality.learn_from(docs, one)[2] > 0


def test_vectors_dense_cells(spark):
    draw = np.random.default_rng(6)
    v = np.concatenate([draw.standard_normal((200, 8)), np.repeat(draw.standard_normal((1, 8)), 60, 0) + draw.standard_normal((60, 8)) * 0.05])
    frame = spark.createDataFrame([(i, [float(y) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    found = vectors.near_vectors(frame).toPandas().sort_values("vec_id")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert found["n_links"].tolist() == ((u @ u.T >= 0.95).sum(axis=1) - 1).tolist()


def test_near_duplicate_stage(spark):
    draw = random.Random(11)
    texts = []
    for n in (40, 60, 120, 300) * 6:
        words = [draw.choice("abcdefgh") + str(draw.randrange(500)) for _ in range(n)]
        texts.append(" ".join(words))
        for edits in (1, 2, 4, 8):  # from alike to unlike
            copy = list(words)
            for _ in range(edits):
                copy[draw.randrange(n)] = "edit" + str(draw.random())
            texts.append(" ".join(copy))
    draw.shuffle(texts)
    words = [t.split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: group.index(g) for g in group}
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_groups(docs).collect()}
    assert found == {i: least[g] for i, g in enumerate(group)}
    assert len(texts) / 4 < len(set(group)) < len(texts)
    assert {r["doc_id"] for r in corpus_pipeline.single(spark, docs, "").collect()} == set(least.values())


def test_imatch_of_long_texts():
    terms = [f"term{i}" for i in range(40_000)]
    lexicon = np.unique(imatch.distinct_terms(imatch.pa.array([" ".join(terms)]))[1])
    prints = imatch.Fingerprints(lexicon)
    for n in (100, 1000, 5000, 20_000):
        near, apart = [], []
        for at in range(0, 16_000, 1000):
            text, following = " ".join(terms[at : at + n]), " ".join((terms[at + n :] + terms)[:n])
            found, many = prints.of(imatch.pa.array([text, imatch.edited(text, following)]))
            near.append(imatch.likeness(found[:1], found[1:], many[:1], many[1:])[0])
            other, count = prints.of(imatch.pa.array([" ".join(f"{n} other{i}" for i in range(n // 2))]))
            apart.append(imatch.likeness(found[:1], other, many[:1], count)[0])
        assert np.mean(near) > 0.15 and np.mean(apart) < 0.05, n


def test_unusable_vectors_of_repeated_ids(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (1, None), (1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    found = vectors.near_vectors(table).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in found) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 0)]


def test_words_that_look_alike_are_told_apart(spark):
    """Two words of 512 letters that a polynomial hash can't tell apart, whatever its base."""
    one = "a"
    while len(one) < 512:
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    held_ids = [i for i in range(50) if held(i, 7, 2)]
    found = katz.score(spark.createDataFrame([(0, one + " x"), (held_ids[0], two)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_known"] for r in found} == {0: 3, held_ids[0]: 1}
    lengths = [*range(1, 30), 255, 256, 257, 600]
    every = imatch.pa.array([" ".join(["q" * n, "q" * (n - 1) + "r", "r" + "q" * (n - 1)]) for n in lengths])
    assert len(set(imatch.batch_words(every)[0].tolist())) == 3 * len(lengths) - 1  # of one letter two are the same


def test_pairs_of_many_words():
    draw = np.random.default_rng(3)
    h, w = (draw.integers(0, 50, 1000).astype(np.uint64) + np.uint64(1 << 40) for _ in range(2))
    a, b, first, at = katz._distinct(h, w)
    assert [*zip(a.tolist(), b.tolist())] == sorted(set(zip(h.tolist(), w.tolist())))
    assert (a[at] == h).all() and (b[at] == w).all() and (h[first] == a).all()
    assert all((x == y).all() for x, y in zip(katz._distinct(h - np.uint64(1 << 40), w - np.uint64(1 << 40))[2:], (first, at)) if len(x) == len(y))


def test_lines_of_long_texts():
    """A text without line ends is one line, however long; lines of long texts are those of short ones."""
    one = "word " * 900_000
    many = ("A line of words.\n" * 5 + "another one\n") * 40_000
    x = quality.statistics(quality.pa.array([one, many, many[:97]]))
    a, b, c = (dict(zip(quality.NAMES, r)) for r in x)
    assert (a["n_lines"], a["line_repeats"], a["line_length"]) == (1, 0, len(one))
    assert (b["n_lines"], b["line_repeats"]) == (240_000, 1 - 2 / 240_000) and b["line_stop"] == pytest.approx(5 / 6)
    assert (c["n_lines"], c["line_stop"]) == (6, 5 / 6)


def plain_statistics(text):
    raw = (text or "").encode()
    lowered = raw.lower()
    words = re.findall(rb"[^\x20\x09-\x0D]+", lowered)
    lines = re.findall(rb"[^\n]+", lowered)
    n, some = len(words), max(1, len(raw))
    pairs = set(zip(words, words[1:]))
    out = {
        "n_bytes": len(raw), "n_words": n, "word_length": sum(map(len, words)) / max(1, n), "longest": max(map(len, words), default=0), "distinct": len(set(words)) / max(1, n),
        "repeated": max((words.count(w) for w in set(words)), default=0) / max(1, n) if n < 3000 else None, "pairs": len(pairs) / max(1, n - 1), "short": sum(len(w) <= 3 for w in words) / max(1, n),
        "n_lines": len(lines), "line_repeats": 1 - len(set(lines)) / len(lines) if lines else 0, "line_length": sum(map(len, lines)) / max(1, len(lines)), "line_stop": sum(x[-1:] in (b".", b"!", b"?") for x in lines) / max(1, len(lines)),
        "capitals": len(re.findall(rb"(?:(?<=[ \n])|^)[A-Z]", raw)) / max(1, n),
    }
    return out | {f"share_{c}": sum(raw.count(bytes([b])) for b in among) / some for c, among in quality.CLASSES.items()}


def test_quality_by_plain_statistics(spark, sf_dir):
    """The query's scores against rules that are fitted on plain statistics and applied row by row."""
    learnt = {}
    for i, y, _ in label_rows():
        if i is not None and y is not None and not held(i, 5, 0):
            learnt[i] = max(y, learnt.get(i, 0))
    def of(text):
        found = plain_statistics(text)
        if found["repeated"] is None:
            words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
            found["repeated"] = max(words.count(w) for w in set(words)) / len(words)
        return [float(found[k]) for k in quality.NAMES]

    every = [(r[0], of(r[1])) for r in rows()]
    sample = {}
    for i, x in every:
        if i in learnt:
            sample[i] = min(x, sample.get(i, x))
    ids = sorted(sample)
    model = quality.fit(np.array([sample[i] for i in ids]), np.array([float(learnt[i]) for i in ids]))
    assert len(ids) < 2 * quality.LEAST or model[0]
    def score(x):
        z = model[2] + sum(w for r, w in zip(model[0], model[1]) if all(x[j] <= v if op == "<=" else x[j] > v for j, op, v in r))
        return 1 / (1 + math.exp(-z))

    assert sorted((number(r.doc_id) or 0, round(r.score, 6)) for r in got(spark, sf_dir, "op8_quality").itertuples()) == sorted((i or 0, round(score(x), 6)) for i, x in every)


def plain_features(text):
    words = [w for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())]
    hashes = [int(toxicity.batch_words(toxicity.pa.array([w.decode()]), toxicity.LETTERS)[0][0]) for w in words] if len(words) < 500 else toxicity.batch_words(toxicity.pa.array([text]), toxicity.LETTERS)[0].tolist()
    found = set(hashes)
    for gap in (1, 2):
        found |= {int(toxicity.mix(np.array([(a * 0x9E3779B97F4A7C15 + b + gap) % 2**64], dtype=np.uint64))[0]) for a, b in set(zip(hashes, hashes[gap:]))}
    return sorted({h >> 44 for h in found})


def test_toxicity_by_plain_ftrl(spark, sf_dir):
    """The query's scores against FTRL-proximal over dictionaries."""
    learnt = {}
    for i, _, y in label_rows():
        if i is not None and y is not None and not held(i, 5, 0):
            learnt[i] = max(y, learnt.get(i, 0))
    every = [(r[0], plain_features(r[1])) for r in rows()]
    sample = {}
    for i, f in every:
        if i in learnt:
            packed = np.array(f, np.int32).tobytes()
            sample[i] = min((packed, f), sample.get(i, (packed, f)))
    ids = sorted(sample)
    docs_of = {}
    for i in ids:
        for f in sample[i][1]:
            docs_of[f] = docs_of.get(f, 0) + 1
    z, n, bias = {}, {}, -1

    def weight(f):
        if f != bias and abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        shrunk = z.get(f, 0.0) - (0 if f == bias else math.copysign(toxicity.L1, z[f]))
        return -shrunk / ((toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA)

    order = np.random.default_rng(0)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(ids)):
            fs = [f for f in sample[ids[k]][1] if docs_of[f] >= toxicity.LEAST_DOCS] + [bias]
            w = [weight(f) for f in fs]
            g = 1 / (1 + math.exp(-sum(w))) - learnt[ids[k]]
            for f, x in zip(fs, w):
                root = math.sqrt(n.get(f, 0.0))
                n[f] = n.get(f, 0.0) + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - root) / toxicity.ALPHA * x
    w = {f: weight(f) for f in z}
    expected = sorted((i or 0, round(1 / (1 + math.exp(-sum(w.get(f, 0.0) for f in fs) - w.get(bias, 0.0))), 6)) for i, fs in every)
    assert sorted((number(r.doc_id) or 0, round(r.score, 6)) for r in got(spark, sf_dir, "op3_toxicity").itertuples()) == expected


def test_repeated_ids_are_learnt_from_once(spark, docs, sf_dir):
    """The sample is bounded in documents, not only in ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    copies = docs.where("doc_id IN (1, 2, 3)").crossJoin(spark.range(300).withColumnRenamed("id", "copy")).drop("copy")
    a, b = toxicity.learn(docs, labels), toxicity.learn(docs.union(copies), labels)
    assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])
    x, y = quality.learn_from(docs, labels), quality.learn_from(docs.union(copies), labels)
    assert x[0] == y[0] and np.allclose(x[1], y[1]) and x[2] == y[2]


def test_rules_for_the_same_rows_are_one():
    """At any number of rows."""
    for n in (1000, 6000):
        draw = np.random.default_rng(0)
        x = np.repeat(draw.random((n, 1)), len(quality.NAMES), axis=1)  # every statistic tells the same
        rules, weights, _ = quality.fit(x, (x[:, 0] > 0.5).astype(float))
        held_by = {quality.holds(r, x).tobytes() for r in rules}
        assert len(held_by) == len(rules) == len(weights) > 0


def test_crowded_shards_are_dealt_out(spark, monkeypatch):
    draw = np.random.default_rng(9)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    group = np.full(400, base[0])
    for _ in range(2):
        group ^= np.uint64(1) << draw.integers(0, 64, 400).astype(np.uint64)
    fps = np.unique(np.concatenate([base, group]))
    frame = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    links = simhash.Links(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 4)
    links.join(a, b)
    for most, rows_, leaf in ((60, 50, 1 << 16), (40, 5000, 64), (10_000, 20, 16)):
        monkeypatch.setattr(simhash, "SHARD_LEAST", most)
        monkeypatch.setattr(simhash, "SHARD_MOST", most)
        monkeypatch.setattr(simhash, "SHARD_ROWS", rows_)
        monkeypatch.setattr(simhash, "LEAF", leaf)
        found = {r["node"]: r["component"] for r in components(simhash.near_pairs(frame)).collect()}
        assert [found.get(i, i) for i in range(len(fps))] == links.root.tolist()


def test_crowded_cells_are_dealt_out(spark, monkeypatch):
    draw = np.random.default_rng(6)
    v = np.concatenate([draw.standard_normal((150, 16)), np.repeat(draw.standard_normal((3, 16)), 50, 0) + draw.standard_normal((150, 16)) * 0.1])
    frame = spark.createDataFrame([(i, [float(np.float32(y)) for y in x], 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    u = np.array([r["embedding"] for r in frame.collect()], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for threshold in (0.95, 0.999, 0.5):
        expected = ((u @ u.T >= threshold).sum(axis=1) - 1).tolist()
        for most, at_once, grid in ((10, 1 << 21, 500_000), (4096, 1 << 9, 30)):
            monkeypatch.setattr(vectors, "CELL_LEAST", most)
            monkeypatch.setattr(vectors, "CELL_MOST", most)
            monkeypatch.setattr(vectors, "AT_ONCE", at_once)
            monkeypatch.setattr(vectors, "GRID_ROWS", grid)
            assert vectors.near_vectors(frame, threshold).toPandas().sort_values("vec_id")["n_links"].tolist() == expected


def test_vectors_of_one_id_are_linked(spark):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.01, 1.0]), (9, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    found = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_vectors(table).collect())
    assert found == [(1, 0, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (9, 0, 9)]


def test_single_stage_keeps_the_least_text_of_an_id(spark):
    rows_ = [(1, "b text", "en", "s", 6), (1, "a text", "en", "s", 6), (1, None, "en", "s", None), (2, "other words here", "en", "s", 1), (None, "x", "en", "s", 1)]
    for order in (rows_, rows_[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
        assert sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.single(spark, docs, "").collect()) == [(0, "x"), (1, None), (2, "other words here")]


def test_stored_tables_need_a_shared_folder(spark):
    from quern.llm import store

    folder = store.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and folder == store.shared_folder(spark)


def test_near_duplicate_stage_goes_by_the_trees(spark, monkeypatch):
    # MinHash proposes nothing here: what is linked comes through the trees over fingerprints, and the exact check after them
    monkeypatch.setattr(shingles, "bands", lambda found: [xxhash.xxh64_intdigest(found.tobytes(), k) - (1 << 63) for k in range(30)] if len(found) else [])
    draw = random.Random(11)
    words = [f"w{draw.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(["first", *words[1:]]), " ".join(f"v{draw.randrange(10**6)}" for _ in range(300)), "", None]
    prints = [simhash.majority(shingles.shingles((t or "").encode())) for t in texts]
    assert all((prints[0] ^ prints[i]).bit_count() <= shingles.BITS for i in (1, 2))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in shingles.near_groups(docs).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}


def test_groups_of_the_trees_are_checked_on_whole_sets(spark, monkeypatch):
    # all fingerprints are in one group: only pairs that are alike may be linked
    monkeypatch.setattr(shingles, "BITS", 64)
    monkeypatch.setattr(shingles, "near_pairs", lambda prints, bits: prints.crossJoin(prints.groupBy().agg({"rep": "min"}).toDF("b")).selectExpr("rep AS a", "b"))
    texts = [" ".join(f"{k}x{i}" for i in range(60)) for k in range(4)]
    texts.append(texts[2] + " end")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in shingles.near_groups(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}


def test_few_links_are_kept_in_few_files(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = components(spark.createDataFrame([(i, i + 1) for i in range(0, 400) if i % 20], "a long, b long"))
        assert len(found.inputFiles()) == 1
        assert {r["component"] for r in found.collect()} == {i + 1 for i in range(0, 400, 20)}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)

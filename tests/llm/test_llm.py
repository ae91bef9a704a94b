"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpusforge.llm import bpe, exact_dedup, language_id, line_dedup, mixing, sharding, simhash, token_counts, token_files, vector_search

RANKS = bpe.public_path("byte_bpe_50k.tiktoken")
TOKENIZER = bpe.public_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size int, `range` int, row int"
LONG = "many words of one long document " * 4000

ROWS = [
    (1, "The  first text has words.\nAnd a second line of words here.", "en", "a"),
    (2, "The first text has words.\nAnd a second line of words here. ", "en", "b"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, " \t ", "fr", "a"),
    (6, LONG, "en", "b"),
    (7, "x" * 30_000, "en", None),
    (8, "日本語 don't 12 é <|endoftext|>", "fr", "c"),
    (8, "日本語 don't 12 é <|endoftext|>", "fr", "c"),
    (None, "A row without an id and words", "fr", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "d", 1, 2, 3) for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("test", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


def test_bpe(docs, none, encoding):
    found = Counter(map(tuple, bpe.round_trip(docs, RANKS).collect()))
    expected = Counter()
    for d, text, *_ in ROWS:
        ids = encoding.encode_ordinary(text or "")
        expected[d, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert found == expected
    assert bpe.round_trip(none, RANKS).count() == 0
    decoded = bpe.decode(bpe.encode(docs.filter("doc_id < 6"), RANKS), RANKS)
    assert {r.doc_id: bytes(r.data).decode() for r in decoded.collect()} == {r[0]: r[1] or "" for r in ROWS[:5]}


def test_pieces_of_odd_texts(encoding):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab e'st  \n\t1.é日\x1c") for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 1500, "".join(rng.choice("etaoin") for _ in range(3000)), "  ", "\n \n", " a  b "]
    merges, chunks = bpe.worker(RANKS, bpe.default_pattern())
    ids = chunks.encode(texts)
    assert ids == [packed(encoding.encode_ordinary(t)) for t in texts]
    assert merges.decode(ids) == [t.encode() for t in texts]


@pytest.mark.parametrize("added", [True, False])
def test_token_files(docs, none, added):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    if not added:
        tokenizer.encode_special_tokens = True
    files = token_files.write_files(docs, TOKENIZER, file_ids=64, **({} if added else {"added_tokens": False}))
    found = token_files.read_documents(files).orderBy("start").collect()
    start, expected = 0, []
    for d, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((d, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert [tuple(r) for r in found] == expected and files.count() > 2
    assert token_files.read_documents(token_files.write_files(none, TOKENIZER)).count() == 0


def test_token_files_know_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = ["end <|endoftext|> next", "plain text", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b <|endoftext", "", "x" * 5000 + " <|endoftext|> it's"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = token_files.write_files(rows, TOKENIZER)
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.read_documents(files).collect()}
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert ids[0] == [437, 220, 50256, 1306, 2] and found == {i: (len(x), zlib.crc32(packed(x))) for i, x in enumerate(ids)}


def test_boundaries_by_select():
    rng = random.Random(2)
    lengths = [rng.choice([0, 0, 1, 7, 300]) for _ in range(500)]
    ends = np.cumsum(lengths)
    file = token_files.TokenFile(token_files.pack([None, *range(499)], ends, np.arange(ends[-1])))
    assert [file.end(i) for i in range(500)] == ends.tolist() == file.ends().tolist()
    assert (file.doc_id(0), file.doc_id(5)) == (None, 4)
    assert file.document(40).tolist() == list(range(ends[39], ends[40]))


def test_files_of_any_ids_and_lengths():
    rng = random.Random(5)
    for _ in range(60):
        n, span = rng.choice([0, 1, 2, 63, 64, 65, 700]), rng.choice([1, 10**6, 2**63 - 1])
        ends = np.cumsum([rng.choice([0, 1, 7, 5000]) for _ in range(n)]).astype(np.int64)
        ids = sorted(rng.randrange(-span, span) for _ in range(n))
        nulls = rng.randrange(min(n, 4) + 1)
        ids[:nulls] = [None] * nulls
        values = np.arange(ends[-1] if n else 0) % 70_000
        file = token_files.TokenFile(token_files.pack(ids, ends, values))
        assert file.ends().tolist() == ends.tolist() and file.doc_ids(np.arange(n)) == ids
        assert all(file.document(i).tolist() == values[ends[i - 1] if i else 0 : ends[i]].tolist() for i in rng.sample(range(n), min(n, 5)))
    with pytest.raises(ValueError):
        token_files.pack([2, 1], np.array([1, 2]), np.array([5, 6]))


def test_shards(spark, docs, none):
    found = sharding.shards(docs, 1000).collect()
    assert len(found) == len(ROWS)
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in ROWS)
    for shard in {r.shard for r in found}:
        members = [r for r in found if r.shard == shard]
        assert {(r.shard_rows, r.shard_bytes) for r in members} == {(len(members), sum(r.n_bytes for r in members))}
        assert len(members) == 1 or sum(r.n_bytes for r in members) <= 1000
    names = sorted({r.shard for r in found})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    copies = spark.createDataFrame([(1, "same text")], "doc_id long, text string").crossJoin(spark.range(5000)).drop("id")
    assert sharding.shards(copies, 900).agg(F.max("shard_bytes"), F.count("*")).first()[:] <= (900, 5000)
    assert sharding.shards(none, 1000).count() == 0
    assert [r.shard for r in sharding.shards(docs.filter("doc_id = 4"), 1000).collect()] == [""]


def test_exact_duplicates(spark, docs, none):
    found = exact_dedup.exact_duplicates(docs).collect()
    by_id = {r.doc_id: r for r in found}
    assert (by_id[2].keep_id, by_id[1].keep_id, by_id[1].group_size) == (1, 1, 2)
    assert [(by_id[i].keep_id, by_id[i].group_size) for i in (3, 4, 5)] == [(5, 3)] * 3
    assert sorted(r.kept for r in found if r.doc_id == 8) == [False, True]
    assert by_id[None].kept and by_id[7].text_sha256 == hashlib.sha256(b"x" * 30_000).hexdigest()
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert exact_dedup.exact_duplicates(hot).filter("kept").count() == 2001
    assert exact_dedup.exact_duplicates(none).count() == 0


def brute_fingerprint(text, n):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash(spark, docs, none):
    found = simhash.near_duplicates(docs, shingle=3, radius=2, jaccard=None).collect()
    prints = {r[0]: brute_fingerprint(r[1], 3) for r in ROWS}
    assert all(r.fingerprint % 2**64 == prints[r.doc_id] for r in found) and len(found) == len(ROWS)
    rows = {r.doc_id: r.component_id for r in found}
    assert (rows[1], rows[2], rows[3], rows[4], rows[5], rows[None]) == (1, 1, 3, 3, 3, None)
    assert simhash.near_duplicates(none).count() == 0
    base = " ".join(f"w{i}" for i in range(300))
    texts = [(1, base), (2, base.replace("w150", "other")), (3, " ".join(f"v{i}" for i in range(300)))]
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


@pytest.mark.parametrize("radius, blocks", [(2, 4), (5, 1), (3, 2)])
def test_links_lose_no_component(spark, radius, blocks):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(30)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for c in centres for _ in range(12)}
    signed = sorted(v - 2**64 if v >= 2**63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), radius, blocks)
    root = dict(simhash.components(edges).collect())
    expected = {v: v for v in signed}

    def find(x):
        while expected[x] != x:
            x = expected[x]
        return x

    for a in signed:
        for b in signed:
            if b < a and ((a ^ b) % 2**64).bit_count() <= radius:
                x, y = find(a), find(b)
                expected[max(x, y)] = min(x, y)
    assert {v: root.get(v, v) for v in signed} == {v: find(v) for v in signed}


def brute_kept(texts, n=5, least=0.8):
    """The ids that stay if every pair of this Jaccard similarity is linked."""
    sets = {}
    for d, t in texts:
        words = t.lower().split()
        sets[d] = {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in sets if find(d) == d)


def family_texts(seed, families, members, words, changes):
    """Families of texts that share a body; in each text some words of it are others."""
    rng, texts = random.Random(seed), []
    for f in range(families):
        body = [f"b{f}x{i}" for i in range(words)]
        for m in range(members):
            own = list(body)
            for i in rng.sample(range(words), rng.randint(*changes)):
                own[i] = f"o{f}x{m}x{i}"
            texts.append((len(texts), " ".join(own)))
    return texts


def test_every_similar_pair_counts(spark):
    texts = family_texts(1, 40, 12, 204, (2, 8))
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == brute_kept(texts)


def test_pairs_of_distant_fingerprints_count(spark):
    texts = family_texts(2, 150, 2, 64, (0, 1))
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    expected = brute_kept(texts)
    prints = {d: brute_fingerprint(t, 5) for d, t in texts}
    assert any((prints[d] ^ prints[d - 1]).bit_count() > 12 for d in range(1, len(texts), 2) if d not in expected)
    assert sorted(r.doc_id for r in kept.collect()) == expected


def test_counters_cover_all_texts(spark):
    texts = [(i, f"the same six words every time {i}") for i in range(300)] + [(300, None), (301, ""), (302, "two words")]
    rows = spark.createDataFrame(texts, "row long, text string").withColumn("text", F.coalesce("text", F.lit("")))
    counts = simhash._counted(rows, 5)
    halves = counts.reshape(2, -1).sum(axis=1)
    assert halves.tolist() == [901, 901]  # three shingles of each of 300 texts, and a text of two words
    often = np.array([xxhash.xxh64_intdigest("the same six words every", seed=42)], dtype="<u8")
    assert all(counts[place[0]] >= 300 for place in simhash._places(often))
    assert not simhash._counted(rows.limit(0), 5).any()


def test_equal_fingerprints_are_no_proof(spark):
    run = " 0" * 600
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(250)) + run) for i in range(3)]
    assert len({brute_fingerprint(t, 5) for _, t in texts}) == 1
    kept = simhash.keep_one(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2] == brute_kept(texts)


def test_mixing(spark, docs, none):
    found = mixing.plan(docs).collect()
    sizes = {}
    for _, text, _, source in ROWS:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3, 1, 2] * 9))
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        level = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if level[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    target |= level
    source = {r[0]: r[3] for r in ROWS}
    assert all(r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 2 * r.size for r in found) and len(found) == len(ROWS)
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.least(F.col("id") % 9, F.lit(5))).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    by_source = mixing.plan(many).join(many.select("doc_id", "source"), "doc_id").groupBy("source")
    for r in by_source.agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 8
    mixed = mixing.mix(many)
    assert mixed.columns == many.columns and mixed.count() == mixing.plan(many).agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs).columns == docs.columns and mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_language_network_learns_and_predicts(spark, none):
    words = {"en": ["the", "and", "with", "that", "this"], "de": ["der", "und", "mit", "dass", "diese"], "fr": ["le", "et", "avec", "que", "cette"]}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k) for i, k in enumerate(list(words) * 60)]
    rows += [(1000, None, "en"), (1001, "12 34 !!", "en"), (None, "the that this", "en"), (1002, "the and " * 20_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    tested = [r for r in rows if r[0] is not None and r[0] < 1000 and found[r[0]].held_out]
    assert all(found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in found if d is not None)
    assert sum(found[d].lang_pred == k for d, _, k in tested) >= 0.95 * len(tested) > 0
    assert (found[1000].lang_pred, found[1001].lang_pred, found[1002].lang_pred, found[None].held_out) == ("und", "und", "en", False)
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and not {1000, 1001} & {r.doc_id for r in kept.collect()}
    empty = none.select("doc_id", "text", "lang")
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


def naive_states(network, windows):
    """The same network, a position at a time."""
    p, found = network.p, []
    for window in windows:
        both = []
        for way, data in enumerate((window, window[::-1])):
            state, states = np.zeros(network.hidden), []
            for byte in data:
                given, back = p["x"][:, way, byte] + p["c"][:, way], np.einsum("k,gkj->gj", state, p["h"][:, way])
                z, r = 1 / (1 + np.exp(-(given[:2] + back[:2])))
                state = (1 - z) * np.tanh(given[2] + r * back[2]) + z * state
                states.append(state)
            both.append(states if way == 0 else states[::-1])
        logits = np.array(both[0]) @ p["o"][0] + np.array(both[1]) @ p["o"][1] + p["oc"]
        e = np.exp(logits)
        found.append(e / e.sum(axis=1, keepdims=True))
    return found


def test_language_network_against_a_naive_one_and_finite_differences():
    random_ = np.random.default_rng(1)
    network = language_id.Network(3, hidden=4, dtype=np.float64)
    for name, v in network.p.items():
        network.p[name] = v + random_.normal(0, 0.3, v.shape)
    windows, labels = [b"hello", b"a", b"\xff\x00zz world"], np.array([0, 2, 1])
    data, lengths = language_id.padded(windows)
    probabilities, expected = network.label(data, lengths), naive_states(network, windows)
    for i, e in enumerate(expected):
        assert np.allclose(probabilities[:, : lengths[i], i].T, e)
    loss, gradients = network.gradients(data, lengths, labels)
    assert loss == pytest.approx(-sum(np.log(e[:, k]).sum() for e, k in zip(expected, labels)) / lengths.sum())
    for name, v in network.p.items():
        for _ in range(30):
            at = tuple(random_.integers(0, n) for n in v.shape)
            if name == "x":
                at = (*at[:2], random_.choice(list(b"".join(windows))), at[3])
            kept, step = v[at], 1e-5
            v[at] = kept + step
            more = network.gradients(data, lengths, labels)[0]
            v[at] = kept - step
            less = network.gradients(data, lengths, labels)[0]
            v[at] = kept
            assert (more - less) / (2 * step) == pytest.approx(gradients[name][at], abs=1e-8)


def test_all_positions_of_whole_texts_count():
    import pyarrow as pa

    model = language_id.Model(["a", "b", "c"], language_id.Network(3, hidden=5))
    texts = ["", "x", "many words " * 100, "y" * 241, "日本" * 200, None]
    found = model.probabilities(pa.array(texts))
    for text, row in zip(texts, found):
        data, sums = (text or "").encode(), np.zeros(3)
        for i in range(0, len(data), language_id.WINDOW_BYTES):
            start = max(0, i - language_id.CONTEXT_BYTES)
            stop = min(i + language_id.WINDOW_BYTES, len(data))
            labels = naive_states(model.network, [data[start : stop + language_id.CONTEXT_BYTES]])[0]
            sums += labels[i - start : stop - start].sum(axis=0)
        assert np.allclose(row, sums / max(1, len(data)), atol=1e-5)


def test_languages_without_spaces_are_learned(spark):
    rng = random.Random(8)
    letters = {"zh": "的一是不了在人有我他这中大来上国", "ja": "のにはをたがでてとしれさあいうえ", "th": "กขคงจชซญดตถทนบปผ", "en": None}
    rows = []
    for i in range(240):
        lang = list(letters)[i % 4]
        text = " ".join(rng.choices("the and of to in that it was for on".split(), k=40)) if lang == "en" else "".join(rng.choices(letters[lang], k=90))
        rows.append((i, text, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    found = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert model.languages == ["en", "ja", "th", "zh"] and all(found[d].lang_pred == lang for d, _, lang in rows)


def test_language_sample_is_bounded_by_ids(spark):
    learned = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = spark.range(3000).select(F.lit(learned).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 7).alias("text"), F.lit("en").alias("lang"))
    clashing = rows.withColumns({"row": F.lit(1), "place": F.lit(2), "lang_pred": F.lit("x"), "score": F.lit("y"), "__text": F.lit("z")})
    kept = language_id.keep_identified(clashing)
    assert kept.columns == clashing.columns and kept.count() == 3000


def brute_lines(rows):
    owners = [(2**63 - 1 if d is None else d, t) for d, t in rows]
    lines = []
    for d, t in owners:
        for pos, line in enumerate((t or "").split("\n")):
            plain = line.strip(" \t\n\x0b\x0c\r")
            tokens = ["<*>" if re.search(r"[0-9@]|://", w) else w for w in re.split(r"[\x20\x09-\x0D]+", plain)]
            if len(tokens) >= 5:
                lines.append((d, pos, t, tuple(tokens)))
    seen, leaf = {}, {}
    for d, pos, _, tokens in sorted(lines, key=lambda x: x[:2]):
        seen.setdefault(tokens, d)
        leaf.setdefault((len(tokens), tokens[:3]), tokens)
    gone = Counter()
    for d, _, t, tokens in set(lines):  # repeated rows are one document
        first = leaf[len(tokens), tokens[:3]]
        keeper = seen[tokens]
        if sum(a == b for a, b in zip(tokens, first)) >= 0.8 * len(tokens):
            keeper = min(keeper, seen[first])
        gone[d, t] += d > keeper
    return gone


def test_lines(spark, none):
    rows = [
        (1, "Call 555 now for more help\nA line that only this one has"),
        (2, "Call 777 now for more help\nshort line\nCall 9 now for more help"),
        (3, "This report was made for Alice in good faith and with care"),
        (4, "This report was made for Bob in good faith and with care\nNew words that are nowhere else"),
        (5, None), (6, ""), (None, "Call 1 now for more help"), (None, "Call 2 now for more help"),
        (7, "\n".join(["the same long line of a text"] * 3000)), (8, "the same long line of a text\n"), (8, "the same long line of a text\n"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pos": F.lit(1), "row": F.lit(2), "leaf": F.lit(3)})
    found = line_dedup.without_recurring_lines(docs)
    expected = brute_lines(rows)
    collected = found.collect()
    assert Counter((r.doc_id, r.lines_dropped) for r in collected) == Counter((d, expected[2**63 - 1 if d is None else d, t]) for d, t in rows)
    by_id = {r.doc_id: r.text for r in collected}
    assert (by_id[2], by_id[4], by_id[5], by_id[6], by_id[8]) == ("short line", "New words that are nowhere else", None, "", "")
    assert found.columns == [*docs.columns, "lines_dropped"] and line_dedup.without_recurring_lines(none).count() == 0


def test_lines_like_any_earlier_one(spark):
    rng = random.Random(3)
    view = "The user has no rights to view this page at all"
    rows = [(1, view)] + [(i, f"The user has logged in as {n} from the main office") for i, n in enumerate(["Alice", "Bob", "Eve"], 2)]
    words = ["red", "green", "blue", "grey"]
    for d in range(5, 200):
        lines = []
        for _ in range(4):
            n = rng.choice([5, 6, 9, 10, 14, 15, 20])
            body = [rng.choice(words) if rng.random() < 0.3 else f"w{i}" for i in range(n - 3)]
            lines.append(" ".join(["one", "two", rng.choice(["three", "four"]), *body]))
        rows.append((d, "\n".join(lines)))
    lines = [(d, line.split()) for d, t in rows for line in t.split("\n")]

    def gone(d, line):
        mine = line.split()
        return any(e < d and len(x) == len(mine) and x[:3] == mine[:3] and sum(map(str.__eq__, x, mine)) >= 0.8 * len(mine) for e, x in lines)

    expected = {d: "\n".join(x for x in t.split("\n") if not gone(d, x)) for d, t in rows}
    found = line_dedup.without_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in found.collect()} == expected and expected[3] == expected[4] == "" and 50 < sum(map(bool, expected.values()))


def test_vector_search(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(700, 16)).astype(np.float32)
    vectors[100:140] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (960, [None] * 16), (None, [1.0] * 16), (980, [1.0, 2.0]), (0, vectors[0].tolist())]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit(9))
    found = vector_search.nearest(table, F.col("vec_id") % 20 == 0, k=20, shard_rows=250).collect()
    exact = vectors.astype(np.float64)
    hits = 0
    for q in range(0, 700, 20):
        answer = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        scores = exact @ exact[q]
        best = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:20]
        hits += len({r.vec_id for r in answer} & set(best))
        assert [r["rank"] for r in answer] == list(range(1, 21)) and all(r.score == pytest.approx(scores[r.vec_id], rel=1e-12) for r in answer)
    assert hits >= 0.97 * 700 and {r.query_id for r in found} == set(range(0, 700, 20))
    assert vector_search.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = vector_search.nearest(table.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]


def test_token_counts(docs, none, encoding):
    counter = token_counts.Counter(RANKS, bpe.default_pattern())
    rng = random.Random(3)
    letters = ["a", "s", "t", "v", "e", " ", " ", "\n", "'", "1", ".", "é", "re"]
    for _ in range(150):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 60, 900])))
        tree = token_counts.TokenTree(counter, text)
        for _ in range(4):
            at, length, new = rng.randrange(len(text) + 1), rng.choice([0, 1, 40]), "".join(rng.choices(letters, k=rng.randrange(4)))
            tree.edit(at, length, new)
            text = text[:at] + new + text[at + length :]
            assert (tree.text(), tree.tokens, tree.characters) == (text, len(encoding.encode_ordinary(text)), len(text))
    edits = F.array(F.struct(F.lit(2).alias("start"), F.lit(3).alias("length"), F.lit(" new").alias("replacement")))
    found = {r.doc_id: r for r in token_counts.counts_after_edits(docs, edits, RANKS).collect()}
    assert all(found[d].n_tokens_edited == len(encoding.encode_ordinary((t or "")[:2] + " new" + (t or "")[5:])) for d, t, *_ in ROWS)
    assert found[6].pieces_reencoded < 20 < found[6].pieces
    assert found[6].n_tokens == len(encoding.encode_ordinary(LONG))
    assert token_counts.counts_after_edits(none, F.lit(None).cast("array<struct<start:int,length:int,replacement:string>>"), RANKS).count() == 0


def test_trees_take_batch_after_batch_of_edits(spark, docs, encoding):
    rng = random.Random(6)
    letters = ["a", "s", "t", "v", " ", " ", "\n", "'", "1", ".", "é"]
    texts = {i: "".join(rng.choices(letters, k=rng.choice([0, 5, 200, 3000]))) for i in range(30)}
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    state = token_counts.trees(rows, RANKS)
    for batch in range(3):
        edits = []
        for d in rng.sample(sorted(texts), 20):
            todo = [(rng.randrange(len(texts[d]) + 2), rng.choice([None, 0, 1, 40]), rng.choice([None, "", "'s", " new words", "x" * 400])) for _ in range(rng.randrange(4))]
            edits.append((d, todo))
            for at, length, new in todo:
                at = min(at, len(texts[d]))
                texts[d] = texts[d][:at] + (new or "") + texts[d][at + (length or 0) :]
        table = spark.createDataFrame(edits, "doc_id long, edits array<struct<start: int, length: int, replacement: string>>")
        state = token_counts.save(token_counts.edited(state.join(table, "doc_id", "left"), F.col("edits"), RANKS), "edited")
        found = state.collect()
        assert {r.doc_id: (r.text, r.n_tokens, r.n_chars) for r in found} == {d: (t, len(encoding.encode_ordinary(t)), len(t)) for d, t in texts.items()}
        untouched = {*texts} - {d for d, todo in edits if todo}
        assert untouched and all(r.pieces_reencoded == 0 for r in found if r.doc_id in untouched)
        assert sum(r.pieces_reencoded for r in found) < sum(r.pieces for r in found)


def brute_line_drops(docs):
    """Texts without recurring lines and how many went; docs: (id, text), ids unique but for None, which comes last."""
    lines, order = {}, lambda d: 2**63 - 1 if d is None else d
    for d, text in docs:
        for line in (text or "").split("\n"):
            tokens = tuple("<*>" if re.search(r"[0-9@]|://", w) else w for w in re.split(r"[\x20\x09-\x0D]+", line.strip(" \t\n\x0b\x0c\r")))
            if len(tokens) >= 5:
                lines.setdefault((len(tokens), tokens[:3]), []).append((order(d), tokens, line))
    found = []
    for d, text in docs:
        kept, parts = [], (text or "").split("\n")
        for line in parts:
            mine = next(((leaf, t) for leaf, rows in lines.items() for o, t, x in rows if x == line and o == order(d)), None)
            gone = mine and any(o < order(d) and t == mine[1] for o, t, _ in lines[mine[0]])
            if mine and not gone:
                first = min(o for o, t, _ in lines[mine[0]] if t == mine[1])
                gone = any(o < first and sum(map(str.__eq__, t, mine[1])) >= 0.8 * len(t) for o, t, _ in lines[mine[0]])
            if not gone:
                kept.append(line)
        found.append(("\n".join(kept) if len(kept) < len(parts) else text, len(parts) - len(kept)))
    return found


def brute_mix(rows):
    """rows (id, text, source) as often as they are taken, in order."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, ramp = dict(zip(order, [3, 1, 2] * 9)), dict(zip(order, [-0.5, 0.0, 0.5] * 9))
    target, open_ = {}, set(order)
    while open_:
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        level = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if level[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else level
        open_ = open_ - over if over else set()
    found = []
    for s in order:
        key = lambda r: int(hashlib.md5(f"{'' if r[0] is None else r[0]}:{size(r[1])}".encode()).hexdigest()[:15], 16)
        offset = 0
        for r in sorted((r for r in rows if r[2] == s), key=lambda r: (key(r), r[0] is not None, r[0] or 0)):
            passes = int(target[s] // sizes[s]) if sizes[s] else 0
            copies = passes + (size(r[1]) > 0 and offset + size(r[1]) / 2 <= target[s] - passes * sizes[s])
            for c in range(copies):
                share = min(1.0, (offset + c * sizes[s] + size(r[1]) / 2) / target[s])
                flat = 1 - ramp[s]
                position = share if ramp[s] == 0 else (np.sqrt(flat * flat + 4 * ramp[s] * share) - flat) / (2 * ramp[s])
                found.append((position, r[0] is not None, r[0] or 0, c, r))
            offset += size(r[1])
    return [(r, p) for p, *_, r in sorted(found, key=lambda x: x[:4])]


def test_mix_is_in_the_order_of_positions(spark, docs):
    rows = [(i, "w " * (i * 7 % 13), f"s{min(i % 9, 4)}" if i % 11 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"from": F.lit(1), "range": F.lit(2), "row": F.lit(3)})
    found = mixing.mix(table.repartition(5)).collect()
    expected = brute_mix(rows)
    assert [r.doc_id for r in found] == [r[0] for r, _ in expected] and len(expected) > 400
    assert mixing.mix(table).columns == table.columns


def test_mixing_query_reads_the_sorted_mix(spark, tmp_path, monkeypatch):
    from corpusforge.llm import catalogue

    rows = [(i, None if i % 50 == 2 else "w " * (i * 7 % 13), f"s{i % 3}" if i % 11 else None) for i in range(400)]
    rows += [(8, "a b", "s1"), (8, "a b", "s1"), (8, "c d", "s1"), (8, " ", "s1"), (8, None, "s1"), (None, "x y", None), (None, "x y", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.op6_mixing(spark, str(tmp_path)).collect()
    at = [2.0 if r.first_position is None else r.first_position for r in found]
    assert at == sorted(at) and len(set(at)) > 200 and at[-1] == 2
    # Rows that share id and size are interchangeable.
    size = lambda t: len((t or "").split())
    expected, given, first = Counter(), Counter(), {}
    for (d, t, _), p in brute_mix(rows):
        expected[d, size(t)] += 1
        first.setdefault((d, size(t)), p)
    for r in found:
        given[r.doc_id, r.size] += r.copies
        assert r.taken == r.copies * r.size and (r.first_position is None) == (r.copies == 0)
        if r.copies:
            assert r.first_position >= first[r.doc_id, r.size] - 1e-9
    assert +given == expected and Counter((r.doc_id, r.size) for r in found) == Counter((d, size(t)) for d, t, _ in rows)
    for key, p in first.items():
        assert min(r.first_position for r in found if (r.doc_id, r.size) == key and r.copies) == pytest.approx(p)
    whole = mixing.in_order
    monkeypatch.setattr(mixing, "in_order", lambda planned: whole(planned).filter("doc_id <> 5"))
    less = {r.doc_id: r for r in catalogue.op6_mixing(spark, str(tmp_path)).collect()}
    assert expected[5, 9] > 0 and (less[5].taken, less[5].copies, less[5].first_position) == (0, 0, None) and less[6].copies > 0


def small_corpus():
    rng = random.Random(12)
    words = {"en": "the and with that this from have were which their".split(), "de": "der und mit dass diese von haben waren welche ihre".split()}
    rows = []
    for i in range(1, 100):
        lang = ["en", "de"][i % 2]
        lines = [" ".join(rng.choices([*words[lang], f"{lang}w{rng.randrange(300)}"], k=rng.choice([3, 8, 30]))) for _ in range(rng.choice([1, 2, 4]))]
        if i % 5 == 0:
            lines.insert(rng.randrange(len(lines) + 1), f"This page was seen {i} times by all of the visitors")
        rows.append((i, "\n".join(lines), lang, ["a", "b", "c", None][i % 4], 0))
    base = " ".join(f"the{i} and" for i in range(120))
    rows += [(200 + i, base.replace(f"the{i * 20} ", f"other{i} "), "en", "a", 0) for i in range(4)]
    rows += [(300, None, "en", "a", 0), (301, "", "de", "b", 0), (302, "12 ?", None, "a", 0), (304, "the and " * 30_000, "en", "b", 0)]
    rows += [(None, "the and with that this no id here at all", "en", "a", 0), (305, "this from have", "en", None, 0), (306, "this from have", "en", "c", 0)]
    return rows


def test_pipeline_against_brute_force(spark, encoding, tmp_path):
    from corpusforge.llm import pipeline

    rows = small_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, position int, `range` int, node int, n_tokens int"
    table = spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], schema)
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = pipeline.run(spark, str(tmp_path))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "score", "position", "range", "node", "n_tokens", "ids"]
    model = language_id.train(table)
    kept = []
    for d, text, lang, source, _ in rows:
        if text and any(map(str.isalpha, text)):
            data, sums = text.encode(), np.zeros(len(model.languages))
            if len(data) > 5000:  # one of a thousand windows is as good as all where all are alike
                data = data[:5000]
            for i in range(0, len(data), language_id.WINDOW_BYTES):
                start, stop = max(0, i - language_id.CONTEXT_BYTES), min(i + language_id.WINDOW_BYTES, len(data))
                labels = naive_states(model.network, [data[start : stop + language_id.CONTEXT_BYTES]])[0]
                sums += labels[i - start : stop - start].sum(axis=0)
            if sums.max() / len(data) >= language_id.LEAST_SCORE:
                kept.append((d, text, source))
    assert len(kept) > 80 and 300 not in [r[0] for r in kept]
    lined = [(d, t, s) for (d, _, s), (t, n) in zip(kept, brute_line_drops([r[:2] for r in kept])) if not (n and not t.strip(" \t\n\x0b\x0c\r"))]
    assert len(lined) < len(kept)
    ids = {*brute_kept([(d, t) for d, t, _ in lined if d is not None]), None}
    single = [r for r in lined if r[0] in ids]
    assert len(single) < len(lined)
    expected = Counter((r[0], r[2], len(r[1]), packed(encoding.encode_ordinary(r[1]))) for r, _ in brute_mix(single))
    assert Counter((r.doc_id, r.source, r.n_chars, bytes(r.ids)) for r in found.collect()) == expected


def test_pipeline_of_no_documents(spark, tmp_path):
    from corpusforge.llm import pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_agrees(spark):
    import duckdb

    from corpusforge.llm import catalogue

    db, sf = duckdb.connect(), "/root/testdata/sf0.001"
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    for name, sql in catalogue.SQL.items():
        rows = catalogue.QUERIES[name](spark, sf)
        columns = sorted(rows.columns)
        expected = db.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, rows.select(columns).collect()))) == sorted(map(repr, expected)) and expected, name


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == before.columns or stage is corpus_pipeline.STAGES[-1][1]
    assert {"doc_id", "n_tokens", "ids"} <= {*docs.columns} and docs.count() > 100

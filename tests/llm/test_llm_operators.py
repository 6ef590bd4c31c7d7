"""Each operator against a plain version on awkward rows, and on empty tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from touchline.llm import fingerprints, language, line_dedup, packing, suffix_dedup, token_files
from touchline.llm.common import connected_components
from touchline.llm.exact_dedup import exact_dedup
from touchline.llm.jaccard_join import jaccard_components
from touchline.llm.mixing import entropy_mix, mixed_documents
from touchline.llm.token_counts import at_limit, quantile, token_counts
from touchline.llm.tokens import ChunkEncoder

BYTE, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def docs(spark):
    return brute.table(spark).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in brute.awkward()]


@pytest.fixture(scope="module")
def empty(spark):
    return brute.table(spark, [])


def library(path, end):
    t = Tokenizer.from_file(path)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, end]


# --- 1 ----------------------------------------------------------------------------
@pytest.mark.parametrize("digest", ["all", "survivors"])
def test_exact_dedup(docs, rows, digest):
    norm = [re.sub(brute.SPACE + "+", " ", t or "") for _, t in rows]
    groups = brute.by(zip(norm, rows), lambda x: x[0])
    want = Counter()
    for (id_, _), t in zip(rows, norm):
        ids = [i for _, (i, _) in groups[t] if i is not None]
        keep = min(ids) if ids else None
        want[(id_, keep, len(groups[t]), id_ == keep, hashlib.sha256(t.encode()).hexdigest())] += 1
    got = exact_dedup(docs, digest=digest).collect()
    if digest == "all":
        assert Counter(map(tuple, got)) == want
    else:  # only rows that share length and prefix are hashed
        assert Counter(tuple(r)[:4] for r in got) == Counter(x[:4] for x in want.elements())
        assert all((r.text_sha256 is not None) for r in got if r.group_size > 1)


# --- 2 ----------------------------------------------------------------------------
def test_token_counts(docs, rows):
    encode = library(BYTE, 0)
    lengths = sorted(len(encode(t)) - 1 for _, t in rows)
    sums = token_counts(docs, BYTE).cache()
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.docs == lengths.count(n)
        assert r.docs_from == sum(x >= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.docs_upto == sum(x <= n for x in lengths)
        assert (r.docs_all, r.tokens_all) == (len(lengths), sum(lengths))
        assert r.truncated == sum(min(x, n) for x in lengths)
    for limit in (0, 7, 10**6):
        r = at_limit(sums, limit).first()
        assert (r.docs_longer, r.truncated) == (sum(x > limit for x in lengths), sum(min(x, limit) for x in lengths))
    assert quantile(sums, 0.5).first()[0] == lengths[-(-len(lengths) // 2) - 1]


def test_chunk_encoder_equals_library():
    import random

    rnd = random.Random(5)
    alphabet = [*"abB'sSΣ s\n\t  \r don't 12é́,.!$<|>\x0b\xa0　中ßµ\x1c", "<|endoftext|>", "  ", "\n\n", "\r\n"]
    for path in (BYTE, WORDS):
        fast, slow = ChunkEncoder(path), Tokenizer.from_file(path)
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 25)))
            ids = np.asarray(slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
            assert fast.encode(text) == ids.tobytes(), text
        long = brute.words(9, 300_000)
        assert fast.encode(long) == np.asarray(slow.encode(long, add_special_tokens=False).ids, dtype="<u4").tobytes()


# --- 3 ----------------------------------------------------------------------------
def test_language_edge_cases(spark, docs, rows, empty):
    model = language.train(docs)
    out = language.identify(docs, model, carry=["key"]).collect()
    assert len(out) == len(rows) and all(r.key == "key" for r in out)
    for r in out:
        if r.doc_id in (4, 5, 6):  # null, empty, blank
            assert (r.id_lang, r.kept) == ("und", False)
    assert language.identify(empty, language.train(empty)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.where("doc_id % 5 > 0"), per_language=60)
    held = docs.where("doc_id % 5 = 0")
    hidden = held.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    told = language.identify(hidden, model).join(held.select("doc_id", "lang"), "doc_id")
    assert told.agg(F.avg((F.col("lang") == F.col("id_lang")).cast("int"))).first()[0] >= 0.99
    assert told.where("NOT kept").count() == 0


def test_text_of_another_language_is_not_kept(spark):
    """Also if a known language is declared and the letters are known."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    other = [
        "Il governo ha annunciato ieri che le nuove misure entreranno in vigore a partire dal prossimo mese, secondo "
        "quanto riferito dai giornali della mattina e dalle agenzie di stampa",
        "De regering heeft gisteren aangekondigd dat de nieuwe maatregelen vanaf volgende maand van kracht worden in "
        "alle gemeenten van het land",
        "Vláda včera oznámila, že nová opatření vstoupí v platnost od příštího měsíce a budou platit do konce roku",
        "これは日本語の文章です。政府は昨日、新しい措置を発表しました。",
    ]
    spec = "doc_id long, text string, lang string, source string"
    rows = spark.createDataFrame([(i, x, lang, "s") for i, x in enumerate(other) for lang in ("es", "it", None)], spec)
    got = language.identify(rows, model).collect()
    assert len(got) == 12 and {(r.id_lang, r.kept) for r in got} == {("und", False)}
    # few clean documents go with them, though nothing but the text is known
    hidden = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    assert language.identify(hidden, model).where("NOT kept").count() <= 0.002 * docs.count()


def test_language_model_does_not_depend_on_the_order(spark):
    rows = [(None, brute.words(i, 40), "en", "s") for i in range(50)] + [(None, brute.words(1, 40), "en", "s")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    models = [language.train(d, per_language=20) for d in (docs.repartition(5), docs.orderBy(F.rand(2)), docs.coalesce(1))]
    assert all(np.array_equal(models[0], m) for m in models)


def test_language_evidence_moves_the_posterior(spark):
    """With an undecided text the declared language, the host and the suffix decide."""
    spec = "page_id long, text string, declared string, host string, domain string, suffix string"
    rows = [(i, "zzq", "de", "www.x.de", "x.de", "de") for i in range(40)] + [
        (100, "zzq", None, "www.x.de", "x.de", "de"), (101, "zzq", None, "new.x.de", "x.de", "de"),
        (102, "zzq", "fr", None, None, None), (103, "zzq", None, "unseen.com", "unseen.com", "com"),
    ]
    flat = np.full((4, language.TABLE), -np.log(language.TABLE), dtype=np.float32)
    out = language.identify(
        spark.createDataFrame(rows, spec), flat, id_col="page_id", declared_col="declared", host_col="host",
        domain_col="domain", suffix_col="suffix",
    )
    got = {r.page_id: (r.id_lang, r.posterior) for r in out.collect()}
    assert got[100][0] == got[101][0] == "de" and got[100][1] >= got[101][1]
    assert got[102][0] == "fr"


def test_page_rows(spark):
    html = '<!DOCTYPE html><HTML class="a" lang="fr-CA"><style>p{}</style><script>x<y</script><p>Bon&nbsp;jour</p></html>'
    rows = [(1, "https://u@www.Example.co.uk:80/a?b#c", html), (2, None, None), (3, "nonsense", "<p>x")]
    got = language.page_rows(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert got[0].text.split() == ["Bon", "jour"]
    assert tuple(got[0])[2:] == ("fr", "www.example.co.uk", "co.uk", "uk")
    assert tuple(got[1])[2:] == (None,) * 4 and tuple(got[2])[2:] == (None,) * 4


# --- 4 ----------------------------------------------------------------------------
def check_plan(histogram: dict[int, int], window: int) -> int:
    """Every id in one place, no gap, and the padding."""
    plan = packing.make_plan(histogram, window)
    lookup, sequences = packing.PlanLookup(plan), {}
    for length, count in histogram.items():
        for rank in range(count):
            at = 0
            for sub, n, seq, offset in lookup.pieces(length, rank):
                assert sub == at
                at += n
                sequences.setdefault(seq, []).append((offset, n))
            assert at == length
    padding = 0
    assert sorted(sequences) == list(range(plan.sequences))
    for parts in sequences.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= window
        padding += window - end if end & (end - 1) else 0
    return padding


def test_plan_is_whole_and_unpadded():
    import random

    rnd = random.Random(2)
    for _ in range(200):
        window = rnd.choice([8, 16, 64])
        histogram = {rnd.randint(1, window - 1): rnd.randint(1, 25) for _ in range(rnd.randint(0, 8))}
        assert check_plan(histogram, window) == 0
    assert check_plan({1500: 500, 3: 2}, 2048) == 0


def test_best_fill_is_optimal():
    import itertools
    import random

    rnd = random.Random(3)
    for _ in range(100):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(4)}
        gap = rnd.randint(0, 30)
        pick = packing.best_fill(counts, gap)
        assert all(0 < k <= counts[x] for x, k in pick.items())
        every = (sum(x * k for x, k in zip(counts, c)) for c in itertools.product(*(range(v + 1) for v in counts.values())))
        assert sum(x * k for x, k in pick.items()) == max(s for s in every if s <= gap)


def check_pieces(pieces, rows, window=2048):
    encode = library(WORDS, 1)
    want = Counter((id_, tuple(encode(t))) for id_, t in rows)
    starts = Counter((r.doc_id, r.doc_tokens) for r in pieces if r.start == 0)
    assert starts == Counter((i, len(t)) for i, t in want.elements())
    assert sum(r.length for r in pieces) == sum(len(t) for _, t in want.elements())
    known = {(i, len(t)): t for i, t in want}
    padding, total = 0, 0
    for parts in brute.by(pieces, lambda r: r.sequence_id).values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
            ids = known[(r.doc_id, r.doc_tokens)][r.start : r.start + r.length]
            assert brute.crc(ids) == r.ids_crc32
        assert end <= window
        padding += window - end if end & (end - 1) else 0
        total += end
    assert padding <= 0.001 * total


def test_packing(docs, rows, empty):
    check_pieces(packing.pack(docs, WORDS).withColumn("ids_crc32", F.crc32("ids")).collect(), rows)
    assert packing.pack(empty, WORDS).count() == 0


def test_packing_over_partitions(docs, rows):
    spread = docs.repartition(5, "n_chars")
    check_pieces(packing.pack(spread, WORDS).withColumn("ids_crc32", F.crc32("ids")).collect(), rows)


# --- 5 ----------------------------------------------------------------------------
def lines_without(rows, min_words=3):
    """Text of each row after dedup, by plain means but for the line hashes."""
    place, sims = {}, {}
    for number, (id_, t) in enumerate(rows):
        for _, line, piece, *_, sim in zip(*line_dedup.line_units([(t or "").encode()], min_words)):
            norm = line_dedup._unit_text((t or "").encode(), line, piece)
            place.setdefault(norm, []).append((id_ is None, id_ or 0, int(line), int(piece), t))
            sims[norm] = int(sim)
    norms = list(place)
    union = brute.Union(len(norms))
    for a in range(len(norms)):
        for b in range(a):
            most = int(0.2 * max(len(norms[a]), len(norms[b])) + 1e-9)
            near = abs(len(norms[a]) - len(norms[b])) <= most
            if near and (sims[norms[a]] ^ sims[norms[b]]).bit_count() <= line_dedup.HAMMING:
                if brute.levenshtein(norms[a], norms[b]) <= most:
                    union.join(a, b)
    first = {}
    for i, norm in enumerate(norms):
        root = union.find(i)
        first[root] = min([*place[norm], *([first[root]] if root in first else [])], key=lambda p: p[:4])
    gone = {}
    for i, norm in enumerate(norms):
        for p in place[norm]:
            if p != first[union.find(i)]:
                gone.setdefault((p[0], p[1], p[4]), set()).add(p[2:4])
    out = Counter()
    for id_, t in rows:
        drop = gone.get((id_ is None, id_ or 0, t), set())
        out[(id_, line_dedup.without_pieces(t, list(drop)) if drop else t, len(drop))] += 1
    return out


def near_lines():
    base = brute.words(20, 60)
    out = [(i, f"{base.replace(base.split()[i], 'zz' + str(i))}\n{brute.words(30 + i, 25)}") for i in range(12)]
    return out + [(50, base.upper() + "!\nshort\n\n" + brute.words(99, 9))]


def test_line_dedup(spark, docs, rows, empty):
    # the two rows with id null and id 9 share no text, so the order of places is total
    rows = [(i, t) for i, t in rows if t is None or len(t) < 100_000]
    got = line_dedup.line_dedup(docs.where("text IS NULL OR length(text) < 100000")).collect()
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == lines_without(rows)
    assert all(r.key == "key" and r.n == 2 for r in got)
    near = near_lines()
    got = line_dedup.line_dedup(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text, r.n_dropped) for r in got) == lines_without(near)
    assert sum(r.n_dropped for r in got) > 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_long_line_in_pieces(spark):
    a = brute.words(40, 3 * line_dedup.LONG)
    tail = brute.words(41, line_dedup.LONG)
    b = " ".join(a.split()[: line_dedup.LONG]) + " " + tail
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")).collect()}
    assert got[1].text == a and got[2].text == tail


def test_units_of_many_texts_are_those_of_each(rows):
    texts = [(t or "").encode() for _, t in rows]
    together = list(zip(*line_dedup.line_units(texts, 1)))
    alone = [(i, *u[1:]) for i, t in enumerate(texts) for u in zip(*line_dedup.line_units([t], 1))]
    assert together == alone


def test_simhash_is_the_majority():
    words = np.random.default_rng(2).integers(0, 2**63, 50, dtype=np.int64).view(np.uint64)
    got = line_dedup.simhash(words, np.array([0, 7, 30]))
    for value, a, b in zip(got.tolist(), [0, 7, 30], [7, 30, 50]):
        for bit in range(64):
            assert (value >> bit & 1) == (2 * sum(int(w) >> bit & 1 for w in words[a:b]) > b - a)


# --- 6 ----------------------------------------------------------------------------
@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components(docs, rows, k, num, den):
    got = Counter(map(tuple, jaccard_components(docs, k=k, threshold=(num, den)).collect()))
    assert got == brute.jaccard_components(rows, k, num, den)


def test_jaccard_chains_and_hot_columns(spark, empty):
    """Chains of near copies whose ends are not linked, a passage in all rows."""
    shared, rows = brute.words(50, 40), []
    for chain in range(6):
        own = brute.words(60 + chain, 80).split()
        for i in range(12):
            own[(i * 3) % 80 : (i * 3) % 80 + 2] = [f"n{chain}x{i}", f"m{chain}x{i}"]
            rows.append((chain * 100 + i, shared + " " + " ".join(own)))
    got = Counter(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute.jaccard_components(rows, 5, 80, 100)
    assert jaccard_components(empty).count() == 0


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (None, 3), (200, 100)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 103, 105, 200)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 7 ----------------------------------------------------------------------------
@pytest.mark.parametrize("width", [2, 4])
def test_token_files_round_trip(spark, docs, rows, width, empty):
    encode = library(BYTE, 0)
    files = token_files.TokenFiles(spark).write(docs, BYTE, shards=3, width=width)
    got = files.read_back(docs).collect()
    assert Counter((r.id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (i, len(encode(t)), brute.crc(encode(t))) for i, t in rows
    )
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))
    unknown = spark.createDataFrame([(10**9 + i,) for i in range(200)], "id long")
    assert files.lookup(unknown).count() == 0
    one = spark.createDataFrame([(13,)], "id long").select(*token_files._hashes(F.col("id"), files.parts)).first()
    places = {r.shard: (r.file, r.width) for r in files.manifest.collect()}
    assert token_files.get(files.path, tuple(one), places) == np.asarray(encode("a  b\tc\x0bd"), dtype="<u4").tobytes()
    nothing = token_files.TokenFiles(spark).write(empty, BYTE)
    assert nothing.read_back(empty).count() == 0


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.int64).view(np.uint64)
    keys = np.r_[keys, keys[:3]]  # three keys with one hash each twice
    ph = token_files.PerfectHash.load(token_files.PerfectHash.build(keys).dump())
    slots = ph.slots(np.unique(keys))
    assert len(set(slots.tolist())) == 5000 and slots.min() >= 0 and slots.max() < len(keys)


# --- 8 ----------------------------------------------------------------------------
def targets(sizes: dict, weights=(5, 2, 1), ratio=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = set(), ratio * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in held]
        if not rest:
            break
        level = (total - sum(cap * sizes[s] for s in held)) / sum(weight[s] for s in rest)
        above = {s for s in rest if level * weight[s] >= cap * sizes[s]}
        if not above:
            break
        held |= above
    return {s: cap * sizes[s] if s in held else level * weight[s] for s in order}


def test_mixing(spark, docs, rows, empty):
    sizes = Counter()
    for r in brute.awkward():
        sizes[r[3]] += len(re.findall(brute.WORD, r[1] or ""))
    want = targets(sizes)
    got = entropy_mix(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and 0 <= r.copies <= 2
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size
    again = entropy_mix(docs.repartition(4)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)
    assert entropy_mix(empty).count() == mixed_documents(empty).count() == 0


def test_mixing_rounds_equal_rows_one_by_one(spark):
    rows = [(None, "one two three four five six seven eight", "a")] * 90 + [(i, brute.words(i, 8), "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    kinds = []
    for part in (docs, docs.coalesce(1)):
        got = entropy_mix(part, weights=(2, 1)).collect()
        for source in "ab":
            mine = [r for r in got if r.source == source]
            assert len(mine) == (90 if source == "a" else 60)
            assert abs(sum(r.taken for r in mine) - mine[0].target) <= 8
        kinds.append(Counter(map(tuple, got)))
    assert kinds[0] == kinds[1]
    assert Counter(map(tuple, mixed_documents(docs, weights=(2, 1)).select("doc_id", "source").collect())) == Counter(
        {(r.doc_id, r.source): 0 for r in got}
    ) + Counter((r.doc_id, r.source) for r in got for _ in range(r.copies))


def test_mixing_meets_targets_and_tilts(spark):
    rows = [(i, brute.words(i, 5 + i * 7 % 60), "abcd"[i % 4]) for i in range(800)]
    got = entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(5, 2, 1)).collect()
    for source, part in brute.by(got, lambda r: r.source).items():
        taken, target = sum(r.taken for r in part), part[0].target
        assert abs(taken - target) <= 65
        # the rates meet the constraint and are exponential in the size
        assert sum(r.rate * r.size for r in part) == pytest.approx(target, rel=1e-6)
        free = [r for r in part if 0 < r.rate < 2]
        if len(free) > 2:
            slopes = [np.log(r.rate) / r.size for r in free]
            assert max(slopes) - min(slopes) < 1e-9


# --- 9 ----------------------------------------------------------------------------
def test_winnowing_choice_and_guarantee(spark):
    texts = [brute.words(i, n) for i, n in enumerate((300, 200, 45))] + ["same word " * 60, "short text", "", "a"]
    texts += ["noSpacesInThisText" * 9, "这是一个没有空格的句子 with words\tand \U00020000\U00020001 ภาษาไทย"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    units = fingerprints.units(F.col("text"))
    out = df.select(
        "text", fingerprints.winnow(F.col("text")).alias("fp"), F.transform(units, lambda x: F.xxhash64(x)).alias("h"),
        fingerprints.positions(fingerprints.winnow(F.col("text"))).alias("at"),
    ).collect()
    for r in out:
        bare = "\u0E00-\u0FFF\u1000-\u109F\u1780-\u17FF\u2E80-\uABFF\uF900-\uFAFF\U00020000-\U0003FFFF"
        want = re.findall(f"[{bare}]|[^ \t-\r{bare}]{{1,8}}", r.text)
        assert len(r.h) == len(want)
        runs = max(len(want) - fingerprints.K_WORDS + 1, min(len(want), 1))
        grams = [r.h[i : i + fingerprints.K_WORDS] for i in range(runs)]
        hashed = [
            x[0] & 0xFFFFFFFF
            for x in spark.createDataFrame([(i, *(g + [None] * 4)[:4]) for i, g in enumerate(grams)], "i int, a long, b long, c long, d long")
            .orderBy("i").select(F.xxhash64("a", "b", "c", "d")).collect()
        ] if grams else []
        chosen = brute.winnow(hashed, fingerprints.W_HASHES)
        assert r.at == [p for p, _ in chosen]
        assert [x >> 31 for x in r.fp] == [h for _, h in chosen]
    # a run of w + k - 1 shared words leaves a common hash
    run = " ".join(texts[0].split()[50 : 50 + fingerprints.W_HASHES + fingerprints.K_WORDS - 1])
    pair = [(1, brute.words(70, 90) + " " + run + " " + brute.words(71, 80)), (2, run + " " + brute.words(72, 90))]
    a, b = (set(x >> 31 for x in r.fp) for r in spark.createDataFrame(pair, "i long, text string").select(fingerprints.winnow(F.col("text")).alias("fp")).collect())
    assert a & b


def test_likeness_does_not_depend_on_the_length(spark):
    """Across 200 characters, with a short next text, and without spaces."""
    base = brute.words(80, 60)
    solid = brute.words(81, 90).replace(" ", "")
    near = solid[:120] + ("a" if solid[120] != "a" else "b") + solid[121:]
    texts = [base[:199], base[:205], base[:250], "x", solid, near, base, brute.words(82, 300), "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(rows).collect()}
    assert got[0].near_next > 0.8 and got[1].near_next > 0.5
    assert got[2].near_edited > 0.4 and got[7].near_edited > 0.5
    assert got[4].near_next > 0.5 and got[4].near_edited > 0.3
    assert got[3].near_next == 0 == got[6].near_next


def test_fingerprint_report(spark, docs, rows, empty):
    unique = [(i, t) for i, t in rows if i is not None and i not in (2, 9)]
    df = docs.where("doc_id IS NOT NULL AND doc_id NOT IN (2, 9)")
    got = {r.doc_id: r for r in fingerprints.fingerprint_report(df).collect()}
    order = sorted(unique)
    for j, (id_, t) in enumerate(order):
        t, nxt = t or "", order[(j + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + nxt[:cut]
        r = got[id_]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == t:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint
    assert got[11].fingerprint == got[12].fingerprint and got[11].near_next == 1
    assert fingerprints.fingerprint_report(docs).count() == len(rows)
    assert fingerprints.fingerprint_report(empty).count() == 0
    assert fingerprints.fingerprint_report(df.limit(1)).count() == 1


# --- 10 ---------------------------------------------------------------------------
@pytest.mark.parametrize("batches", [1, 3, 4])
def test_suffix_dedup(docs, rows, batches):
    got = suffix_dedup.suffix_dedup(docs, batches=batches).collect()
    want = brute.repeated_bytes([t for _, t in rows], 200)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == Counter(
        (i, *w) for (i, _), w in zip(rows, want)
    )


def test_suffix_dedup_hot_and_periodic(spark, empty, monkeypatch):
    """Periodic texts, overlaps within a document, one passage with many
    different surroundings (also by the distributed count), tile edges."""
    passage = brute.words(80, 50)
    rows = [(i, brute.words(90 + i, 20 + i) + passage + brute.words(190 + i, 30)) for i in range(25)]
    rows += [(100, "ab" * 300), (101, "x" * 199), (102, "y" * 201), (103, "z" * 200), (104, passage[:199]), (105, passage * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: w[1:3] for (i, _), w in zip(rows, brute.repeated_bytes([t for _, t in rows], 200))}
    for hot, tile in ((20_000, 1 << 20), (5, 1 << 20)):
        monkeypatch.setattr(suffix_dedup, "HOT_CELLS", hot)
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(df).collect()}
        assert got == want
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_tiles_do_not_change_the_windows():
    data = brute.words(7, 4000).encode()
    whole = suffix_dedup.sample(data, 200, 32)
    assert sum(int(w.sum()) for *_, w in whole) == len(data) - 199


def test_family_is_logarithmic(spark):
    family = suffix_dedup.SuffixFamily(spark, 50, 16)
    known = suffix_dedup._known(spark.createDataFrame([(i, brute.words(i, 40)) for i in range(14)], "doc_id long, text string"), "doc_id", "text")
    for i in range(7):
        family.add(known.where(F.col("id").isin(2 * i, 2 * i + 1)))
        assert sorted(family.levels) == [b for b in range(3) if (i + 1) >> b & 1]

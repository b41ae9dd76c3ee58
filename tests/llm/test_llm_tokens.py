"""Pieces, byte tokens, packing and fertility against the libraries and brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from loomgrid.llm import byte_tokens, fertility, packing, pieces

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab ▁\n\t  'sé漢字🎉<0x0A></s>\0​½①Ⅷﬁ\x85\x1c　１"


def odd_texts(n=300):
    draw = random.Random(2)
    made = ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 40))) for _ in range(n)]
    return [*made, "", " ", "   a", "▁", "▁▁", "<s>", "a" * 500, "the " * 100, "�", "<|endoftext|> a", "b" * 30_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_pieces_and_spans_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = odd_texts()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None])], "doc_id long, text string, ids_sha256 string")
    got = {r["doc_id"]: r for r in pieces.with_pieces(rows, PIECE).collect()}
    model = pieces.load(PIECE)
    for i, text in enumerate([*texts, ""]):
        ids = library.encode(text)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert got[i]["decoded_sha256"] == sha(library.decode(ids)) == sha(model.decode(ids))
        told = [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert model.spans(text) == told
    assert pieces.with_spans(rows.where("doc_id < 5"), PIECE).count() == 5
    assert pieces.with_pieces(rows.limit(0), PIECE).count() == 0


def test_any_ids_decode_like_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.load(PIECE)
    draw = random.Random(4)
    for _ in range(500):
        ids = [draw.choice([draw.randint(0, 300), draw.randint(3, 31_999)]) for _ in range(draw.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_compiled_maps_normalise_like_the_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = pieces.proto.ModelProto.FromString(library.serialized_model_proto()).normalizer_spec
    model = object.__new__(pieces.PieceModel)
    model.map = pieces.CharacterMap(spec.precompiled_charsmap)
    model.dummy, model.squeeze, model.escape = True, True, True
    for text in [*odd_texts(150), "ﷺ ①② Å ﬁ ½ ㌔ ｶﾞ Ｆｕｌｌ　width", "  two  spaces  "]:
        normal, origin = model.normalise(text)
        assert normal == library.normalize(text)
        assert len(origin) == len(normal.encode()) + 1 and origin == sorted(origin)
        assert origin[-1] <= len(text.encode())


def test_byte_tokens_equal_the_library():
    library, mine = Tokenizer.from_file(BYTE), byte_tokens.load(BYTE)
    assert mine.fast
    for text in odd_texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == want


def least_sequences(lengths, capacity):
    """Fewest sequences, by trying every way to fill them."""
    best = len(lengths)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for room in {x for x in loads if x + lengths[i] <= capacity}:
            k = loads.index(room)
            go(i + 1, [*loads[:k], room + lengths[i], *loads[k + 1 :]])
        go(i + 1, [*loads, lengths[i]])

    go(0, [])
    return best


def check_runs(plan, counts, capacity):
    places = defaultdict(list)
    for length, first, stop, sequence, each, offset in plan.runs:
        for k in range(stop - first):
            places[sequence + k // each].append((offset + k % each * length, length))
    assert sorted(places) == list(range(plan.sequences))
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    assert Counter(n for taken in places.values() for _, n in taken) == Counter(counts)


@pytest.mark.parametrize("seed", range(40))
def test_fixed_sets_keep_the_best_packing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 17, 30])
    lengths = sorted((draw.randint(1, capacity) for _ in range(draw.randint(1, 9))), reverse=True)
    counts = dict(Counter(lengths))
    reduced = packing.Plan(counts, capacity)
    reduced.reduce()
    rest = list(itertools.chain.from_iterable([w] * n for w, n in reduced.left.items()))
    assert reduced.fixed + least_sequences(rest, capacity) == least_sequences(lengths, capacity)
    whole = packing.plan(counts, capacity)
    check_runs(whole, counts, capacity)
    assert whole.sequences >= least_sequences(lengths, capacity)


def test_plans_of_many_documents_are_near_the_bound():
    draw = random.Random(0)
    counts = Counter(min(1024, int(draw.lognormvariate(6, 0.8)) + 1) for _ in range(20_000))
    plan = packing.plan(dict(counts))
    check_runs(plan, counts, 1024)
    bound = -(-sum(n * w for w, n in counts.items()) // 1024)
    assert plan.sequences <= 1.01 * bound
    assert packing.plan({}).sequences == 0


def test_pieces_of_documents_are_packed_whole(spark, monkeypatch):
    monkeypatch.setattr(packing, "PART", 3)
    texts = ["the cat sat", None, "", "é " * 40, "word " * 200, "the cat sat", "x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, "the cat sat"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS rank")
    got = packing.pack(df, BYTE, capacity=32).toPandas()
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 32 or 32
        ends = [cut, *range(cut + 32, len(ids) + 1, 32)]
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want.append((str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got["doc_id"] = [str(None if x != x else int(x)) for x in got["doc_id"]]
    found = got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)
    assert sorted(found) == sorted(want)
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *seq["length"].cumsum().tolist()[:-1]] and seq["length"].sum() <= 32
    assert packing.pack(df.limit(0), BYTE).count() == 0


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered))


def test_base_counts_and_verdicts(spark):
    draw = random.Random(8)
    vocabulary = ["the", "cat", "sat\n", "on", "#a", "é|", "mat.", "\n", "dog ran far\n"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randint(0, 60))) for _ in range(80)]
    plain = [" ".join(draw.sample("time people water house river table green small letter paper window garden music".split(), 12)) for _ in range(60)]
    junk = "".join(chr(draw.randint(0x12000, 0x12300)) + " " for _ in range(40))
    rows = [(i, t, "en", "k", True) for i, t in enumerate([*texts, None, "", "a b c d e " * 40])]
    rows += [(1000 + i, t, "xx", "k", True) for i, t in enumerate(plain)] + [(2000, junk, "xx", "k", True), (2001, junk, None, "k", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, kept boolean")
    got = {r["doc_id"]: r for r in fertility.judge(df, BYTE, PIECE).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        counts = brute_counts(text or "")
        assert tuple(got[i][c] for c in fertility.COUNTS) == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert got[i]["base_failed"] == failed and not (failed and got[i]["kept"])
    assert all(got[1000 + i]["kept"] for i in range(60))
    assert not got[2000]["kept"] and not got[2000]["base_failed"]
    # a text alone in its language and script meets the bands of all texts
    assert got[2000]["byte_share"] > 0.5 and not got[2001]["kept"] and not got[2001]["base_failed"]
    assert {i: r["kept"] for i, r in got.items()} == brute_verdicts(got, {i: x for i, _, x, *_ in rows})
    assert fertility.judge(df.limit(0), BYTE, PIECE).count() == 0


def brute_verdicts(measured, lang):
    """Verdicts from the counts and figures of all texts, with bands worked out in one place."""
    passed = {i: r for i, r in measured.items() if not r["base_failed"]}
    order = {i: math.floor(math.log2(max(r["word_chars"], 1))) for i, r in passed.items()}
    told = {}
    for i, r in measured.items():
        told[i] = i in passed
        if i not in passed:
            continue
        cells = [
            [k for k in passed if lang[k] == lang[i] and order[k] == order[i]],
            [k for k in passed if lang[k] == lang[i] and abs(order[k] - order[i]) <= 1],
            [k for k in passed if lang[k] == lang[i]],
            [k for k in passed if passed[k]["script"] == r["script"]],
            list(passed),
        ]
        cell = next((c for c in cells[:-1] if len(c) >= fertility.LEAST), cells[-1])
        for f, (spreads, least) in fertility.BANDS.items():
            values = sorted(passed[k][f] for k in cell)
            low, high = (values[math.ceil(p * len(values)) - 1] for p in (0.25, 0.75))
            scale = math.sqrt(fertility.MARGIN_CHARS / 2 ** order[i])
            if spreads[0] and r[f] < low - max(spreads[0] * (high - low), least[0] * scale):
                told[i] = False
            if spreads[1] and r[f] > high + max(spreads[1] * (high - low), least[1] * scale):
                told[i] = False
    return told


def test_long_words_of_a_pattern_are_told_apart(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = thue.translate(str.maketrans("ab", "ba"))
    text = "\n".join([thue, other, thue, "w " * 5, "éa" * 50_000])
    df = spark.createDataFrame([(1, text, "en"), (1, text, "en"), (2, "字 " * 3, None)], "doc_id long, text string, lang string")
    got = fertility.judge(df, BYTE, PIECE).collect()
    assert [r["n_dup_lines"] for r in got if r["doc_id"] == 1] == [1, 1] and len(got) == 3
    assert {r["doc_id"]: r["script"] for r in got} == {1: "latin", 2: "5b"}
    assert all(tuple(r[c] for c in fertility.COUNTS) == brute_counts(text) for r in got if r["doc_id"] == 1)


def test_piece_counts_equal_the_library(spark):
    meter = fertility.Meter(BYTE, PIECE)
    for text in [*odd_texts(100), "▁a ▁ b", " lead and trail ", "a\u200bb", "x" * 500]:
        ids = meter.library.encode(text)
        want = sum(bool(meter.is_byte[i]) for i in ids) / max(len(ids), 1)
        for _ in range(2):  # new words, then remembered ones
            assert (meter.byte_shares([text])[0] or 0.0) == want


def test_a_text_alone_in_its_order_meets_the_band_of_its_language(spark):
    draw = random.Random(8)
    names = "time people water house river table green small letter paper window garden music".split()
    rows = [(i, " ".join(draw.sample(names, 12)), "xx") for i in range(60)]
    rows += [(100 + k, " ".join(chr(draw.randint(0x12000, 0x12300)) for _ in range(n)), "xx") for k, n in enumerate((40, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in fertility.judge(df, BYTE, PIECE).collect()}
    assert all(got[i]["kept"] for i in range(60))
    assert not any(got[i]["base_failed"] or got[i]["kept"] for i in (100, 101))

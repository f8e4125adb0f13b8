"""Parts that need no session, against brute force and known values."""

import io
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from stratacloud.llm import contamination, neardup, packing, tokenfile, toxicity, warc
from stratacloud.llm.common import shingle_sets, text_bytes
from stratacloud.llm.language import Model
from stratacloud.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_gives_the_librarys_ids():
    random.seed(1)
    encoder = Encoder(PATH, most_pieces=500)
    for letters in ("aAéÉß'’ſŉİΣς12²½ \t\n\x1c\x85\xa0_-<|>sStTḿ漢", "aAéÉß'’ª_~^'123SsTtRrEeVvMmLlDd  ''ſ\n"):
        texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 20))) for _ in range(2000)] + [None, "", "x" * 50_000]
        for text, ids in zip(texts, encoder.encode(pa.record_batch({"text": pa.array(texts, pa.string())})), strict=True):
            assert encoder.whole.encode(text or "", add_special_tokens=False).ids == ids.tolist()


def test_encoder_keeps_added_tokens():
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = ["a <|endoftext|> b", "plain", "a<|startoftext|>b<|endoftext|>", "<|", "endoftext|>", "a <|ENDOFTEXT|> b", "<|startoftext|>", "é <|endoftext|> ②", None]
    for text, ids in zip(texts, encoder.encode(pa.record_batch({"text": pa.array(texts, pa.string())})), strict=True):
        assert library.encode(text or "", add_special_tokens=False).ids == ids.tolist()
    assert encoder.encode(pa.record_batch({"text": pa.array(texts[:1])}))[0].tolist() == [320, 49407, 321]


def test_best_fill_equals_all_subsets():
    random.seed(2)
    for _ in range(200):
        lengths = [random.randint(1, 20) for _ in range(random.randint(0, 8))]
        room = random.randint(1, 40)
        sums = {sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k)}
        counts = {n: lengths.count(n) for n in lengths}
        best, used = packing.best_fill(counts, room)
        assert best == max(s for s in sums if s <= room) == sum(n * k for n, k in used.items())
        assert all(k <= counts[n] for n, k in used.items())


def test_plan_uses_each_piece_once():
    counts = {5: 3, 3: 4, 2: 1, 7: 1}
    patterns, over = packing.plan(counts, 8)
    total = dict(over)
    for used, times in patterns:
        assert sum(n * k for n, k in used.items()) == 8
        for n, k in used.items():
            total[n] = total.get(n, 0) + k * times
    assert total == counts


@pytest.mark.parametrize("width", [1, 3, 7, 13, 16, 17, 31, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001).astype(np.uint32)
    raw = tokenfile.pack_bits(ids, width)
    assert len(raw) == 8 * -(-1001 * width // 64)
    assert (tokenfile.unpack_bits(raw, width, 1001) == ids).all()


def test_token_file_round_trip():
    random.seed(3)
    docs = [(i if i != 4 else None, np.asarray([random.randrange(50) for _ in range(random.choice([0, 1, 5, 40]))], np.uint32)) for i in range(30)]
    sink = io.BytesIO()
    writer = tokenfile.Writer(sink, 50, block_ids=16)
    for doc, ids in docs:
        writer.add(doc, ids)
    assert writer.close() == len(sink.getvalue())

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read_at(self, count, at):
            return self.getvalue()[at:at + count]

    reader = tokenfile.Reader(Source(sink.getvalue()))
    assert reader.meta["width"] == 6
    assert [ids.tolist() for _, ids in reader.documents()] == [ids.tolist() for _, ids in docs]
    assert reader.document(7).tolist() == docs[7][1].tolist()
    with pytest.raises(ValueError):
        writer.add(1, np.asarray([50], np.uint32))


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_shingle_sets_are_sets_of_words():
    random.seed(4)
    texts = [" ".join(random.choice(["a", "B", "b", "é", "\xa0", "cc"]) for _ in range(random.randint(0, 12))) for _ in range(300)]
    texts += [None, "", " \t", "One", "one", " a b c d e f g "]
    sets = shingle_sets(*text_bytes(pa.record_batch({"text": pa.array(texts)})))
    for (a, x), (b, y) in itertools.combinations(list(zip(texts, sets, strict=True)), 2):
        one, two = shingles(a), shingles(b)
        assert len(x) == len(one)
        assert len(np.intersect1d(x, y)) == len(one & two)


def test_signature_estimates_similarity():
    random_ = np.random.default_rng(5)
    for share in (0.3, 0.6, 0.9):
        both = random_.integers(0, 1 << 63, int(2000 * share)).astype(np.uint64) * np.uint64(2)
        rest = random_.integers(0, 1 << 63, (2, int(1000 * (1 - share)))).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        one, two = (np.unique(np.concatenate([both, r])) for r in rest)
        found, used = neardup.estimate(neardup.signature(one), neardup.signature(two)[None], len(one), np.asarray([len(two)]))
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        assert abs(found[0] - true) < 4 * np.sqrt(true * (1 - true) / used[0]) + 1e-3


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
    return min(row)


def test_best_match_equals_the_table():
    random.seed(6)
    for _ in range(300):
        item, text = ("".join(random.choice("abc") for _ in range(random.randint(1, n))).encode() for n in (12, 25))
        best, end = contamination.best_match(item, text)
        assert best == edit_distance(item, text)
        assert best == len(item) or edit_distance(item, text[:end]) == best


def test_records_of_one_stream_and_of_members():
    pages = [(1, "http://a/ b", b"x" * 10), (None, None, b""), (3, "c", "é\r\n\r\n".encode() * 9)]
    raw = [warc.record(*p) for p in pages] + [warc.record(9, "d", b"x" * 10, 1)]
    for blob in (zlib.compressobj(6, zlib.DEFLATED, 31), None):
        data = blob.compress(b"".join(raw)) + blob.flush() if blob else b"".join(warc.member(r) for r in raw)
        found = list(warc.records(io.BytesIO(data).read))
        assert found == raw
    rows = [warc.parsed(r) for r in raw]
    assert [r["page_id"] for r in rows] == [1, None, 3, 9]
    assert (rows[3]["record_type"], rows[3]["refers_to"], rows[3]["payload_bytes"]) == ("revisit", 1, 10)
    assert rows[1]["payload_digest"] == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    with pytest.raises(ValueError):
        warc.parsed(raw[0].replace(b"xxx", b"xyx"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(warc.member(raw[0][:-6])).read))


def test_unseen_words_back_off():
    model = Model(["a", "b"], {}, {"<xy": np.array([-1.0, -3.0]), "x": np.array([-5.0, -6.0])})
    assert model.unseen("xyz").tolist() == pytest.approx([-0.16, -0.48])
    assert model.unseen("qqq").tolist() == [0, 0]


def test_misspelt_words_score_like_their_model():
    random.seed(7)
    words = ["alpha", "bravo", "delta", "gamma", "sigma", "omega", "kappa", "theta"]
    texts = [[random.choice(words) for _ in range(20)] for _ in range(200)]
    for text in texts[::2]:
        text[5] = random.choice(["horrible", "horribly", "horribles"])
    model = toxicity.fit([" ".join(t) for t in texts], [1, 0] * 100)
    tests = ["alpha bravo horriblle delta gamma", "alpha bravo delta gamma sigma", "", None]
    found = toxicity._highest(model, *toxicity.subwords(*text_bytes(pa.record_batch({"text": pa.array(tests)}))))
    odds = model.scale * found + model.bias
    assert odds[0] > 0 > odds[1] and odds[2] == odds[3]
    assert toxicity.fit(["a"], [1]).bias > 0 > toxicity.fit([], []).bias


def _edited(random_, text, edits, letters):
    out = list(text)
    for _ in range(edits):
        at = random_.randrange(len(out))
        kind = random_.choice("sdi")
        if kind == "d":
            del out[at]
        else:
            out[at:at + (kind == "s")] = random_.choice(letters)
    return "".join(out)


def _contaminated(items, docs, rate=0.2, edits=0.08):
    """Rows (doc_id, item_id, start, end, distance) of the search, with ids in the order of the lists."""
    walks = contamination.Walks(contamination.repetitions(0.99, edits))
    batch = pa.record_batch({"doc_id": pa.array(range(len(docs)), pa.int64()), "text": pa.array(docs, pa.string())})
    out = contamination._search(list(enumerate(items)), walks, rate, edits)(iter([batch]))
    return [tuple(r[c] for c in ("doc_id", "item_id", "start", "end", "distance")) for b in out for r in b.to_pylist()]


@pytest.mark.parametrize("blanks", [True, False])
def test_contamination_finds_items_of_every_size_with_the_edits_expected(blanks):
    random_ = random.Random(7 + blanks)
    letters = "abcdefghijklmnopqrstuvwxyz" + "    " * blanks

    def prose(size):
        return "x" + "".join(random_.choice(letters) for _ in range(size - 2)) + "y"

    sizes = [20, 24, 25, 32, 47, 48, 50, 60, 75, 100, 130, 180, 260, 300]
    items = [prose(m) for m in sizes for _ in range(15)]
    docs = [prose(400) + " " + _edited(random_, t, int(0.08 * len(t)), letters) + " " + prose(400) for t in items]
    found = _contaminated(items, docs + [prose(2000) for _ in range(50)])
    right = {(d, i) for d, i, *_ in found if d == i}
    missed = [len(items[i]) for i in range(len(items)) if (i, i) not in right]
    assert len(missed) <= 0.01 * len(items) and all(m >= 130 for m in missed), missed
    assert {(d, i) for d, i, *_ in found} == right
    for d, i, start, end, distance in found:
        assert contamination.best_match(items[i].encode(), docs[d][start:end].encode())[0] == distance


def test_contamination_of_short_items():
    docs = ["Paris, in FRANCE.", "parisian", "a paris", "comparis", "paris" * 3, "é paris é", "é-parisé", None, "", "  "]
    assert [r[0] for r in _contaminated(["paris"], docs)] == [0, 2, 5]
    assert _contaminated(["", " ", "\t", None], docs) == []
    # repeated in one text: each place is a row, code points count
    assert [r[2:] for r in _contaminated(["paris"], ["é paris paris ü paris"])] == [(2, 7, 0), (8, 13, 0), (16, 21, 0)]
    assert [r[2:4] for r in _contaminated(["東京都に住んでいる人の数は何人ですか"], ["それは東京都に住んでいる人の数は何人ですかと"])] == [(3, 21)]

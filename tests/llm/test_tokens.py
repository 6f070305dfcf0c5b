"""Packing, byte-level BPE and id files against the public libraries and by round trip."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from feedlens.llm import bpe, chunks, idcoder, idfiles, packing

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def buffer(texts):
    data = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])


def odd_texts(n=1500):
    rnd = random.Random(1)
    letters = "ab \n\t　  \u0085'sé1!.,\U0001f600K\x1c"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("path, special", [(WORDS, packing.SPECIAL), (BYTES, idfiles.SPECIAL)])
def test_runs_give_the_librarys_ids(texts, path, special):
    from tokenizers import Tokenizer
    every = texts + odd_texts()
    ids, off = chunks.library_encoder(path, special)(*buffer(every))
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in every], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [w.ids for w in want]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_plain_letters_may_skip_to_the_model(path):
    from tokenizers import Tokenizer
    tok, rnd = Tokenizer.from_file(path), random.Random(5)
    word = chunks.model_word(tok)
    for _ in range(3000):
        run = rnd.choice(["", " "]) + "".join(rnd.choices(chunks._LETTERS, k=rnd.randint(1, 300 if rnd.random() < .05 else 12)))
        assert [t.id for t in tok.model.tokenize(word(run))] == tok.encode(run, add_special_tokens=False).ids


def test_a_full_run_memory_keeps_what_was_met_again():
    asked = []
    runs = chunks.RunEncoder(lambda x: asked.extend(x) or (np.array([len(r) for r in x], np.uint32), np.ones(len(x), int)), 12)
    for k in range(8):
        ids, off = runs.texts(*buffer([f"of the {k}1 {k}2 {k}3", "the"]))
        assert ids.tolist() == [2, 4, 3, 3, 3, 3] and off.tolist() == [0, 5, 6]
    assert sorted(asked).count(b" the") == 1 and len(runs.known) <= 12


def test_packing_encodes_few_bytes_at_once(spark, monkeypatch):
    """Memory of a worker: a batch of many texts reaches the encoder in slices, all of it."""
    seen = spark.sparkContext.accumulator(0)
    most = 2_500_000

    def counting(*_):
        def texts(buf, docs):
            assert len(buf) <= most
            seen.add(len(buf))
            return np.zeros(len(docs) - 1, np.uint32), np.arange(len(docs))
        return texts

    monkeypatch.setattr(packing, "worker_encoder", counting)
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', 400) AS text").coalesce(1)
    assert packing.token_pieces(df, "none").count() == 3000 and seen.value == 3000 * 2000


def test_pairs_of_tokens_are_judged_as_merging_does():
    rnd = random.Random(9)
    ranks = {bytes([c]): c for c in b"abc"}
    for k in range(60):                              # some words are made by no merge, as real lists have
        ranks.setdefault(bytes(rnd.choices(b"abc", k=rnd.randint(2, 6))), 200 + k)
    machine = bpe.MergeTransducer(ranks)

    def merged(piece):
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while True:
            rank, at = min(((ranks.get(a + b, 999), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(999, 0))
            if rank == 999:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    for a in machine.words:
        assert machine.follows(-1, a) == (merged(machine.words[a]) == [a])
        for b in machine.words:
            if machine.follows(-1, a):
                assert machine.follows(a, b) == (merged(machine.words[a] + machine.words[b]) == [a, b])


def test_the_run_memory_may_start_anew(texts):
    machine = bpe.MergeTransducer(bpe.read_ranks(MULTI), max_states=20)
    runs = chunks.RunEncoder(lambda x: (np.concatenate([np.array(machine.encode(r), np.uint32) for r in x]),
                                        np.array([len(machine.encode(r)) for r in x])), limit=10)
    plain = bpe.MergeTransducer(bpe.read_ranks(MULTI))
    buf, off = buffer(["ab cd", "ef gh ij kl mn op qr st uv wx yz"])
    for _ in range(3):
        ids, _ = runs.texts(buf, off)
        assert ids.tolist() == [i for r in (b"ab", b" cd", b"ef", b" gh", b" ij", b" kl", b" mn", b" op", b" qr",
                                            b" st", b" uv", b" wx", b" yz") for i in plain.encode(r)]


def test_transducer_is_tiktoken(texts):
    import tiktoken
    every = texts + odd_texts() + ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=50)) for k in range(300)]
    ranks = bpe.read_ranks(MULTI)
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids, off = bpe.run_encoder(MULTI, public_tokenizers.PATTERN).texts(*buffer(every))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [want.encode_ordinary(t or "") for t in every]


@pytest.mark.parametrize("portion", [1, 2, 3, 7])
def test_streaming_decode(portion):
    decoder = bpe.StreamDecoder({bytes([b]): b for b in range(256)})
    data = "a é 漢 \U0001f600 z".encode()
    parts = [decoder.feed(data[k:k + portion]) for k in range(0, len(data), portion)]
    assert "".join(parts) + decoder.close() == data.decode()
    assert decoder.feed("é".encode()[:1]) == "" and decoder.close() == "�"
    bad = b"\xed\xa0\x80 \xf5 \xc0\x80 \xe2\x82"
    parts = [decoder.feed(bad[k:k + portion]) for k in range(0, len(bad), portion)]
    assert ("".join(parts) + decoder.close()).replace("�", "").split() == []


def test_encode_decode_operator(docs, texts):
    rows = {r.doc_id: r for r in bpe.encode_decode(docs, MULTI, public_tokenizers.PATTERN, with_ids=True).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert rows[k].n_tokens == len(rows[k].ids)
        assert rows[k].ids_sha256 == hashlib.sha256(np.array(rows[k].ids, "<u4").tobytes()).hexdigest()
    assert bpe.encode_decode(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0


def test_best_fit_plans_fill_without_gaps():
    rnd = random.Random(5)
    for _ in range(200):
        cap = rnd.randint(1, 60)
        counts = {n: rnd.randint(1, 30) for n in rnd.sample(range(1, cap + 1), rnd.randint(1, cap))}
        want, used = dict(counts), {}
        for length, first, n, start, per, offset in packing.best_fit_plan(counts, cap):
            for k in range(n):
                used.setdefault(start + k // per, []).append((offset + k % per * length, length))
            want[length] -= n
        assert not any(want.values())
        for bin_ in used.values():
            at = 0
            for offset, length in sorted(bin_):
                assert offset == at
                at += length
            assert at <= cap
        # best-fit decreasing as it is defined, one piece at a time
        room = []
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                best = min((r for r in room if r >= length), default=None)
                if best is None:
                    room.append(cap - length)
                else:
                    room[room.index(best)] -= length
        assert len(used) == len(room)


@pytest.mark.parametrize("capacity, salt", [(64, 7), (4096, 200_000)])
def test_pack_operator(spark, docs, texts, capacity, salt):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(WORDS)
    pieces = packing.token_pieces(docs, WORDS, capacity).cache()
    rows = packing.pack(pieces, capacity, rows_per_salt=salt).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(of[k], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity))
        for r in own:
            part = np.array(ids[r.start:r.start + capacity], "<u4")
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part))
    place = {}
    for r in rows:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in place.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack_documents(docs.limit(0), WORDS).count() == 0


@pytest.mark.parametrize("top", [1, 300, 50_257, 1 << 20])
def test_range_coder_round_trip(top):
    rng = np.random.default_rng(1)
    blocks = [rng.integers(0, top, rng.integers(0, 200)).astype(np.uint32) for _ in range(20)]
    blocks += [np.zeros(500, np.uint32), np.full(300, top - 1, np.uint32), np.tile(np.arange(min(top, 40)), 9).astype(np.uint32)]
    digits = idcoder.digits_for(top)
    coded = idcoder.encode_blocks(blocks, digits)
    sizes = np.array([len(b) for b in blocks])
    back = idcoder.decode_blocks(coded, sizes, digits)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    # a block stands alone: its bytes and its reading do not depend on the others
    assert idcoder.encode_blocks(blocks[-1:], digits) == coded[-1:]
    assert np.array_equal(idcoder.decode_blocks(coded[3:4], sizes[3:4], digits)[0], blocks[3])
    assert len(coded[-2]) < 300


def test_segments_notice_damage():
    parts = [([5, None, 7], np.array([2, 0, 3]), np.arange(5, dtype=np.uint32)), ([], np.zeros(0, int), np.zeros(0, np.uint32))]
    data = idcoder.write_segments(parts, block=2)
    back = idcoder.read_segments(data)
    assert back[0][0] == [5, None, 7] and back[0][2].tolist() == list(range(5)) and back[1][0] == []
    for at in (0, 30, len(data[0]) - 5):
        bad = bytearray(data[0])
        bad[at] ^= 1
        with pytest.raises(ValueError):
            idcoder.read_segments([bytes(bad)])


def test_id_files_operator(spark, docs, texts, monkeypatch):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTES)
    rows = idfiles.encode_and_read(docs, BYTES, files=3).orderBy("doc_id").collect()
    at = 0
    for k, (r, t) in enumerate(zip(rows, texts)):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert len(rows) == len(texts)
    assert idfiles.encode_and_read(docs.limit(0), BYTES).count() == 0
    again = spark.createDataFrame([(None, "n"), (1, "b"), (1, "a")], "doc_id long, text string")
    assert [r.start for r in idfiles.encode_and_read(again, BYTES).orderBy("start").collect()] == [0, 2, 4]

import zlib
from collections import defaultdict
from functools import cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm import common, packing, token_store
from tessella.llm.tokens import WordEncoder, tokenizer_path

BYTE, WORD = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
PIECES = st.sampled_from(["the", "Word", "'s", "don't", " ", "  ", "\n", "\t", ",", ".", "...", "é", "x́", "İ", "Σας", "12", "3.5", "<|endoftext|>", "*$", "ß", "\x1c", "\xa0", "日本"])


cached_encoder = cache(WordEncoder)


@cache
def plain(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=25).map("".join)), max_size=5))
def test_words_give_the_ids_of_the_whole_texts(texts):
    for path in (BYTE, WORD):
        e = cached_encoder(path)
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [plain(path)(t) for t in texts]


def test_words_are_forgotten():
    e = WordEncoder(BYTE, max_words=10)
    for j in range(20):
        texts = [" ".join(f"w{i * j}" for i in range(30)), "a b"]
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.batch(texts)] == [plain(BYTE)(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=0, max_size=600), st.integers(0, 200), st.integers(0, 200))
def test_grammar_round_trip_and_random_access(ids, a, b):
    seq = np.array(ids, np.uint16)
    symbols, rules = token_store.repair(seq, 7, least=3)
    shard = token_store.Shard({"vocab": 7, "width": 4, "symbols": symbols.astype("<u4").tobytes(), "rules": rules.astype("<u4").tobytes(), "expansions": token_store.expansion_lengths(rules, 7).astype("<u4").tobytes()})
    assert shard.ids().tolist() == ids
    assert shard.slice(a, a + b).tolist() == ids[a : a + b]
    assert len(symbols) <= max(len(ids), 1)


def test_store_equals_plain_encoding(spark, docs, rows):
    path = common.shared_dir(spark) + "/t"
    token_store.write_tokens(docs, path, BYTE, shard_tokens=3000)
    got = sorted(((r["doc_id"] is not None, r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_store.read_tokens(spark, path).collect()), key=lambda r: (r[0], r[1] or 0, r[2]))
    enc, start, want = plain(BYTE), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*enc(text), 2], "<u4")
        want.append((doc_id is not None, doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert got == want


def test_store_of_nothing(spark, empty):
    path = common.shared_dir(spark) + "/t"
    token_store.write_tokens(empty, path, BYTE)
    assert token_store.read_tokens(spark, path).count() == 0


def test_packing_keeps_every_id_once(docs, wide, rows):
    for window in (64, 4096):
        got = [r.asDict() for r in packing.pack(wide if window == 64 else docs, WORD, window=window, group_rows=7).collect()]
        seqs, pieces = defaultdict(list), defaultdict(list)
        for r in got:
            seqs[r["sequence_id"]].append((r["offset"], r["length"]))
            pieces[r["doc_id"]].append(r)
        for s in seqs.values():
            at = 0
            for offset, length in sorted(s):
                assert offset == at
                at += length
            assert at <= window
        enc = plain(WORD)
        for doc_id, text, *_ in rows:
            ids = np.array([*enc(text), 2], "<u4")
            mine = sorted(pieces[doc_id], key=lambda r: r["start"])
            if doc_id != 305:
                assert [r["start"] for r in mine] == list(range(0, len(ids), window))
            assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) and r["doc_tokens"] == len(ids) for r in mine)
        assert len(pieces[305]) == 2 * -(-len([*enc("Two words"), 2]) // window)
        assert sorted(seqs) == list(range(len(seqs)))


def test_packing_of_nothing(empty):
    assert packing.pack(empty, WORD).count() == 0


def test_patterns_use_the_histogram_up():
    h = {4096: 3, 3000: 5, 1000: 9, 96: 40, 7: 1}
    used = defaultdict(int)
    for count, pattern in packing.shortest_pack_first(h, 4096):
        assert sum(pattern) <= 4096
        for n in pattern:
            used[n] += count
    assert dict(used) == h

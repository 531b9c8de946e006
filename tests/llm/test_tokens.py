import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from larder.llm import tokens
from larder.llm.common import new_folder
from larder.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def checked(found, rows, plain):
    """Rows of (doc_id, text) in file order against plain encoding."""
    start, want = 0, []
    for doc_id, text in rows:
        ids = plain(text) + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_round_trip_of_all_documents(documents, texts, plain):
    checked(tokens.encoded(documents, tokenizer_path()), sorted(texts.items()), plain)


def test_odd_rows_come_back_in_order(odd, plain):
    found = tokens.encoded(odd, tokenizer_path()).collect()
    assert len(found) == odd.count()
    by_start = sorted(found, key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in by_start]
    assert ids == sorted(ids)
    assert [r.start for r in by_start][1:] == list(np.cumsum([r.n_tokens for r in by_start]))[:-1]
    want = sorted(len(plain(r.text)) + 1 for r in odd.collect())
    assert sorted(r.n_tokens for r in found) == want


def test_memory_bound_does_not_change_ids(monkeypatch, texts, plain):
    monkeypatch.setattr(tokens, "MEMO", 50)
    encoder = tokens.Encoder(tokenizer_path())
    odd = ["á b\x0bc\x1cd\x85e", "ÀÉ ß ſ ﬁ İ", "don't I'LL 'sx x's", "a<|endoftext|>b <|startoftext|>", "x ̈y áb  "]
    some = [*texts.values()][:20] + odd + [None, "", " \t", "ABC,, abc. Abc Œuvre Ÿ ÿ÷×"]
    assert encoder.splits
    coded = lambda t: None if t is None else t.encode()
    for text in some:
        ids = np.frombuffer(encoder.encode([coded(text)])[0], encoder.dtype)
        assert ids.tolist() == plain(text), text
    together = encoder.encode([coded(t) for t in some])
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in together] == [plain(t) for t in some]


def test_the_memo_keeps_what_was_used_lately():
    memo, learnt = tokens.Memo(4, 1000), []
    for i in range(40):
        memo.renew()
        numbers = [memo[k] for k in (b"often", b"k%d" % i, b"often")]
        new, memo.new = memo.new, []
        learnt += new
        memo.learn(new, [k + b"!" for k in new])
        assert [memo.values_of[n] for n in numbers] == [b"often!", b"k%d!" % i, b"often!"]
        assert len(memo) + len(memo.old) <= 12
    assert learnt.count(b"often") == 1
    assert memo[b"x"] >= 0
    memo.learn([b"x"], [b"v" * 2000])
    memo.renew()
    assert len(memo) == 0 and not memo.values_of


def test_another_tokenizer_gets_whole_texts(texts):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, direct = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.splits
    for text in [*texts.values()][:5]:
        ids = np.frombuffer(encoder.encode([(text or "").encode()])[0], encoder.dtype).tolist()
        assert ids == direct.encode(text or "", add_special_tokens=False).ids


def test_any_sequence_is_a_view_of_the_file(spark, documents, texts, plain):
    root = new_folder(spark, "tokens")
    manifest = tokens.write_tokens(documents, tokenizer_path(), root, length=64).collect()
    stream = [i for _, t in sorted(texts.items()) for i in plain(t) + [1]]
    for part in manifest[:2]:
        own = stream[part.start : part.start + part.n_tokens]
        for row in (0, len(own) // 64 // 2, (len(own) - 1) // 64):
            ids, mask = tokens.read_sequence(root, part.ids_path, row)
            here = own[row * 64 : row * 64 + 64]
            assert ids[: len(here)].tolist() == here and not ids[len(here) :].any()
            assert mask.to_pylist() == [True] * len(here) + [False] * (64 - len(here))
            assert not ids.flags.owndata


def test_empty_table(empty):
    assert tokens.encoded(empty, tokenizer_path()).collect() == []


def test_clashing_columns(clashing, odd):
    first = tokens.encoded(clashing, tokenizer_path()).collect()
    assert sorted(map(str, first)) == sorted(map(str, tokens.encoded(odd, tokenizer_path()).collect()))

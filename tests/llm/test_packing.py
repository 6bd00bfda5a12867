import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import packing

from . import brute

PATH = public_tokenizers.path(packing.TOKENIZER)


def packed_ok(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    return len(by)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_is_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    bins, left = {}, {}
    for length, rank, n, first, each, at in packing.plan(counts, 40):
        assert rank == left.get(length, 0)
        left[length] = rank + n
        for j in range(n):
            bins.setdefault(first + j // each, []).append((at + j % each * length, length))
    assert left == counts
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 40
    assert len(bins) == brute.best_fit_bins(lengths, 40)


def test_plan_is_short_for_any_corpus():
    counts = {n: 10**9 + 7 * n for n in range(1, 4097)}
    assert len(packing.plan(counts)) < 12 * 4 * 4096


def test_tree_finds_the_tightest():
    tree = packing.SegmentTree(40)
    for n in (3, 17, 40):
        tree.add(n, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 17, 18, 40)] == [3, 3, 17, 17, 40, 40]
    tree.add(40, -1)
    assert tree.tightest(18) is None


def test_documents_equal_brute_force(spark, docs):
    out = packing.pack(docs, PATH).collect()
    want = brute.token_pieces([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    assert packed_ok(out, 4096) == brute.best_fit_bins([w[3] for w in want])


def test_odd_rows(spark, odd_docs, no_docs):
    out = packing.pack(odd_docs, PATH, size=64, salts=4).collect()
    want = brute.token_pieces([(r.doc_id, r.text) for r in odd_docs.collect()], 64)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in out) == sorted(map(key, want))
    packed_ok(out, 64)
    assert packing.pack(no_docs, PATH).collect() == []


@pytest.mark.parametrize("text", ["don't we'll. x.y., a.. b.,c , . ,, É. é, ß, İ. ŉ, ſt. Ǆ café́, 日本語。 ٣, 3. a3. <|endoftext|> x<|startoftext|>. <|EndOfText|>", " a b\x85c. 'S 's. ’s é's. ÅNG ﬁ.. ªº. ½. \x1ca\x1d.", "🙂. ́, á. ΑΣ. ΟΔΟΣ,", ""])
def test_chunks_encode_like_texts(text):
    import numpy as np
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(PATH).text(text), "<u4").tolist() == want


@pytest.mark.parametrize("text", ["Hello World <| x <|endoftext|> The.", "<|endoftext|>Hello hello HELLO, Hello. hEllo", "A <| B", "The <|EndOfText|> End. the"])
def test_capitals_beside_a_special_token(text):
    import numpy as np
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(PATH).text(text), "<u4").tolist() == want


def test_random_strings_encode_like_texts():
    """Capitals, marks, special tokens, odd white space; one encoder, whose cache fills as it goes."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    rng, own, whole = random.Random(5), packing.Encoder(PATH), Tokenizer.from_file(PATH)
    signs = [*"aAbBzIiİıßŉÉéÅΣσςſǆǅ日本。.,'’!?<|>  \t\n\x0b\x85\xa0\u0301\u0307\u034510٣½ªºﬁ🙂\u200d\x1c", "<|", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'s", "'T", "The", "Hello", "world.", "İ.", "É."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(60_000)]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(own.text(text), "<u4").tolist() == want.ids, text


def test_ids_do_not_depend_on_what_was_seen():
    for text in ("İ.", "GALERİ,", "ŉ.", "Ǆ."):
        fresh = packing.Encoder(PATH).text(text)
        seen = packing.Encoder(PATH)
        seen.text(text[:-1])
        assert seen.text(text) == fresh

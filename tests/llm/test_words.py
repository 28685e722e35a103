from hypothesis import given
from hypothesis import strategies as st

from cladeflow.llm.words import hash_words, words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ09 é-\n漢_😀", max_size=40)), max_size=6))
def test_hashes_follow_the_words(texts):
    hashes, counts = hash_words(texts)
    split = [words(t) for t in texts]
    assert counts.tolist() == [len(w) for w in split]
    flat = [w for part in split for w in part]
    for w, h in zip(flat, hashes.tolist()):
        assert hash_words([w.decode()])[0].tolist() == [h]
    assert len(set(hashes.tolist())) == len(set(flat))


def test_long_words_differ_in_their_ends():
    found, _ = hash_words(["a" * 100 + "b", "a" * 100 + "c", "a" * 101, "b" + "a" * 100])
    assert len(set(found.tolist())) == 4

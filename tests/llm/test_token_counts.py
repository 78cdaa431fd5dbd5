import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import token_counts as T
from pagelattice.llm.sentencepieces import load_model


def greedy(word, initial, later, longest=64):
    """Longest match first, as the definition says; -1 where none fits."""
    count, at = 0, 0
    while at < len(word) or count == 0:
        known = later if count else initial
        end = next((j for j in range(min(len(word), at + longest), at - 1, -1) if word[at:j] in known and (j > at or count == 0)), None)
        if end is None:
            return -1
        count, at = count + 1, end
    return count


@settings(max_examples=400, deadline=None)
@given(
    st.sets(st.text(alphabet="abc", min_size=0, max_size=5), max_size=12), st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=12),
    st.lists(st.text(alphabet="abcd", min_size=1, max_size=14), max_size=20),
)
def test_small_vocabularies(initial, later, words):
    automaton = T.Automaton(initial, later)
    for word in words:
        assert automaton.count(word) == greedy(word, initial, later)


def test_real_vocabulary(spark, sf):
    initial, later = T.vocabulary(load_model())
    automaton = T.Automaton(initial, later)
    words = {w for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for w in r.text.split()}
    rng = random.Random(4)
    words |= {"".join(rng.choice("ethransioéß日x%") for _ in range(rng.randint(1, 30))) for _ in range(2000)}
    for word in words:
        assert automaton.count(word) == greedy(word, initial, later)


def test_long_word_in_linear_steps():
    automaton = T.Automaton({"a"}, {"a", "aa", "aaa", "aaaaaaaab"})
    assert automaton.count("a" * 100_001) == 1 + 33_333 + 1


def test_rows(spark, odd_docs, no_docs):
    initial, later = T.vocabulary(load_model())
    want = []
    for r in odd_docs.collect():
        counts = [greedy(w, initial, later) for w in (r.text or "").split()]
        want.append((r.doc_id, len(counts), sum(1 if c < 0 else c for c in counts), sum(c < 0 for c in counts)))
    got = [tuple(r) for r in T.count_rows(odd_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert T.count_rows(no_docs).collect() == []

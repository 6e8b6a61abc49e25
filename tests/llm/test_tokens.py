import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lexhaven.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def greedy(word, pieces):
    """Pieces by trying the longest first; one for a word that cannot be cut whole."""
    n, at = 0, 0
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in pieces), None)
        if size is None:
            return 1
        n, at = n + 1, at + size
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), min_size=1, max_size=12), st.text(alphabet="abcd", min_size=1, max_size=14))
def test_automaton_is_greedy(pieces, word):
    assert tokens.Automaton(pieces).count(word) == greedy(word, pieces)


def test_documents_against_brute_force(given):
    pieces = set(tokens.read_vocabulary(PATH))
    letters = tokens.byte_letters()

    def count(text):
        found = regex.findall(tokens.PRETOKEN, text.lower())
        return sum(greedy("".join(letters[b] for b in w.encode()) + tokens.END, pieces) for w in found)

    source = given("documents")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(source, PATH).collect()}
    rows = source.orderBy("n_chars").collect()
    assert len(got) == len(rows)
    for row in rows[:100]:
        assert got[row.doc_id] == (len(row.text.split()), count(row.text))


def test_edges(edges, docs):
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in tokens.token_counts(edges, PATH).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == (1, 1)
    assert got[5] == got[6] and got[7][0] == 100_000
    assert tokens.token_counts(docs([]), PATH).count() == 0

"""Known words of a text are looked up once, and missing ones are encoded as before."""

from caseflow.llm.tokens import WordEncoder, tokenizer


class Counted(dict):
    calls = 0

    def get(self, *a):
        Counted.calls += 1
        return dict.get(self, *a)

    def __contains__(self, k):
        Counted.calls += 1
        return dict.__contains__(self, k)

    def __getitem__(self, k):
        Counted.calls += 1
        return dict.__getitem__(self, k)


def test_known_words_cost_one_look_up():
    texts = ["one two  three\ttwo two", "", "two three four", "one"]
    for ids in (True, False):
        enc = WordEncoder(None, ids=ids)
        enc.cache = Counted()
        want = [tokenizer(None).encode(t, add_special_tokens=False).ids for t in texts]
        for _ in range(2):
            Counted.calls = 0
            got = [list(x) for x in enc(texts)]
            if ids:
                assert [[int.from_bytes(raw[i:i + 4], "little") for i in range(0, len(raw), 4)] for raw in map(b"".join, got)] == want
            else:
                assert [sum(x) for x in got] == list(map(len, want))
        assert Counted.calls == sum(len(x) - 1 for x in got)

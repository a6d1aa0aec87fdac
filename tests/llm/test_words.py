import numpy as np

from candlewick.llm import words


def test_words_are_those_of_bytes_split():
    rng = np.random.default_rng(0)
    raws = [None, b"", b"  ", b"A a\x00b\tC\x0b\x0cc\r\n", "É é İ ".encode() * 3, b"x" * 3000 + b" y", b"", b"zz"]
    raws += [bytes(rng.choice(np.frombuffer(b"aAbB \n\x00\xc3", np.uint8), rng.integers(0, 60))) for _ in range(300)]
    h, n = words.Hasher()(raws)
    want = [r.lower().split() if r else [] for r in raws]
    assert n.tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    code = {}
    for x, k in zip(flat, h.tolist(), strict=True):
        assert code.setdefault(x, k) == k
    assert len(set(code.values())) == len(code) and len(code) > 100
    sets = words.shingle_sets(h, n)
    for w, s in zip(want, sets, strict=True):
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else ())

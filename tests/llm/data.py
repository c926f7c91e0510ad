"""Small documents with copies, near copies and odd rows."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(["ab", "ce", "di", "fo", "gu", "lan", "mer", "nos", "pra"]) for _ in range(r.randint(1, 4))) for _ in range(n)]


def documents() -> list[tuple]:
    out = []
    for k in range(60):
        out.append((k, " ".join(words(k, 30 + k)), "en", f"s{k % 3}", 0))
    base = words(7, 37)
    for k in range(60, 80):  # near copies of 7, each with one other word changed
        w = list(base)
        w[k - 50] = f"x{k}"
        out.append((k, " ".join(w), "en", "s0", 0))
    out += [(k, " ".join(words(9, 39)).upper(), "en", "s1", 0) for k in range(80, 90)]  # copies of 9 in capitals
    shared = words(1000, 60)
    out += [(k, " ".join(shared + words(2000 + k, 25)), "de", "s2", 0) for k in range(90, 130)]  # a common passage
    out += [(130, None, None, None, None), (131, "", "en", "s1", 0), (132, "  \n\t ", "en", "s1", 0), (133, "two words", "fr", "s1", 0), (134, "Two  WORDS", "fr", "s1", 0)]
    out += [(135, " ".join(words(5, 20000)), "en", "s0", 0), (136, "one\nsame line\ntwo", "en", "s0", 0), (136, "one\nsame line\ntwo", "en", "s0", 0)]
    return out

"""Small invented corpora for the tests."""

import random

SYLLABLES = ["ba", "do", "ki", "lu", "me", "no", "pra", "sti", "ver", "zo"]
INSULTS = ["gromblat", "fizwort", "snarkel"]


def word(draw: random.Random) -> str:
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3)))


def text(draw: random.Random, n: int) -> str:
    return " ".join(word(draw) for _ in range(n)) + "."


def documents(n: int = 240, seed: int = 1) -> tuple[list, list]:
    """(documents, labels): every 5th text junk, every 4th toxic, with a null, an empty and a very long text at the end."""
    draw = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        t = text(draw, draw.randint(30, 80))
        if i % 5 == 0:
            t = " ".join(w + "###" if k % 2 else "|" for k, w in enumerate(t.split()))
        elif i % 4 == 0:
            words = t.split()
            for insult in draw.sample(INSULTS, 2):
                words.insert(draw.randrange(len(words)), insult)
            t = " ".join(words)
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 10 != 7:
            labels.append((i, int(i % 5 != 0), int(i % 5 != 0 and i % 4 == 0)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s0", 0), (n + 2, text(draw, 30_000), "en", "s1", None),
             (n + 3, " \t\n ", "en", None, 3)]
    return docs + docs[3:5], labels

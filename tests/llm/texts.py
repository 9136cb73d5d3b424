"""Small corpora with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, id int, row int, line string, count int"


def prose(rng: random.Random, words: int) -> str:
    syllables = "the an ti on er re ha nd th st en at to it or is hi es ng".split()
    out = []
    for i in range(words):
        out.append("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "", "", ",", "."]))
    return "".join(w + ("\n" if rng.random() < 0.05 else " ") for w in out).strip()


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"changed{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed: int = 5) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(30)]
    passage = prose(rng, 80)
    rows: list[tuple[int | None, str | None]] = list(enumerate(base))
    rows += [(100 + i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(8)]
    rows += [(200 + i, base[i % 4]) for i in range(8)]  # exact copies
    rows += [(300 + i, edited(rng, base[i], 1)) for i in range(10) if len(base[i].split()) > 100]
    rows += [(400, prose(rng, 6000)), (401, "é" * 500 + " x"), (402, "a" * 3000), (403, " \t\n "), (404, ""), (405, None), (None, base[7]), (None, prose(rng, 100)), (None, None)]
    rows += [rows[3], rows[3], (3, "another text with the same id " + base[5])]  # repeated rows, a repeated id
    rows += [(500 + i, passage) for i in range(3)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, lang: str = "en"):
    data = [(i, t, lang, f"src{k % 3}" if k % 7 else None, len(t or ""), "n", 1, 2, "l", 3) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)

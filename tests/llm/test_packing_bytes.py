"""op2: a text's ids are found in one call, and are those of its runs one by one, as before."""

import random
import re


def test_ids_of_a_whole_text_are_those_of_its_runs():
    from utterset.llm import packing

    with open(packing.VOCABULARY, "rb") as f:
        encode = packing.encoder(f.read())
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    run = re.compile(f" ?[^{space}]+|[{space}]+(?![^{space}])|[{space}]+")
    rng = random.Random(2)
    parts = ["the", " the", "'ll", "  ", "\n", "　", "质", "x" * 70, " 12", "?!", "\x1c", "é", "\x85", "\xa0 "]
    for text in ["", " ", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(300))]:
        assert encode(text) == [i for part in run.findall(text) for i in encode(part)]


def test_a_worker_remembers_no_runs():
    """Most of the time went into runs that a bounded memory had lost again."""
    from utterset.llm import packing

    assert not hasattr(packing, "CACHE")

"""What a Python worker holds: the packing encoder's tables, and what is left of a table it let go of."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RESIDENT = """
def resident():
    return int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20
"""


def _printed(code: str) -> list[int]:
    done = subprocess.run([sys.executable, "-c", RESIDENT + code], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    return [int(x) for x in done.stdout.split()]


def test_encoder_stays_small_on_many_distinct_words():
    """800,000 words that are all different: the tables are emptied on the way."""
    before, after = _printed("""
from itertools import islice, product
from string import ascii_lowercase
from routewise.llm.packing import Encoder, tokenizer_path
words = map("".join, product(ascii_lowercase, repeat=6))
encoder = Encoder(tokenizer_path())
before, most = resident(), 0
for _ in range(8):
    encoder.encode([" ".join(islice(words, 100_000)).encode()])
    most = max(most, resident())
print(before, most)
""")
    assert after - before < 180, (before, after)


def test_encoder_learns_in_steps():
    """More new words at once than a step takes, of all kinds, give the tokenizer's own ids."""
    from itertools import islice, product
    from string import ascii_lowercase

    from tokenizers import Tokenizer

    from routewise.llm import packing

    words = ["".join(w) + end for w, end in zip(islice(product(ascii_lowercase, repeat=4), 80_000), [".", "", ",", "7"] * 20_000)]
    texts = [" ".join(words), "", " ".join(words[::-1]), words[-1]]
    encoder = packing.Encoder(packing.tokenizer_path())
    model = Tokenizer.from_file(packing.tokenizer_path())
    for _ in range(2):  # learnt, and known
        found = encoder.encode([t.encode() for t in texts])
        assert [x.tolist() for x in found] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_worker_gives_memory_back():
    """Freed memory below something that stays goes back to the system when a worker turns to another key."""
    full, left = _printed("""
from routewise.llm.common import worker_kept
worker_kept(("a",), lambda: [bytes(5000) + b"x" for _ in range(60_000)])
stays, full = [bytes(5000) + b"x" for _ in range(10)], resident()
worker_kept(("b",), list)
print(full, resident())
""")
    assert full - left > 200, (full, left)

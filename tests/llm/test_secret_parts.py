"""Random keys behind readable prefixes, and of letters alone."""

import random
import string

import pytest

secrets = pytest.importorskip("trackloom.llm.secrets")
from trackloom.llm import queries  # noqa: E402


def test_keys_behind_paths_and_of_letters_are_found():
    with open(queries.tokenizer("byte_bpe_50k.tiktoken"), "rb") as f:
        scanner = secrets.Scanner(f.read())
    rng = random.Random(1)
    prefix = "config/production/database/"
    hit = 0
    for _ in range(500):
        key = "".join(rng.choices(string.ascii_letters + string.digits, k=24))
        hit += any(b == len(prefix + key) for _, _, b in scanner.scan(prefix + key))
    assert hit >= 450
    letters = ["".join(rng.choices(string.ascii_letters, k=24)) for _ in range(200)]
    assert sum(bool(scanner.scan(x)) for x in letters) >= 150
    for name in ("config/production/database/settings", "getElementsByClassNameAndIndex", "internationalization/localization", "AbstractSingletonProxyFactoryBean"):
        assert not scanner.scan(name), name


def test_many_base_spans_and_runs_take_no_square_of_time():
    import time

    with open(queries.tokenizer("byte_bpe_50k.tiktoken"), "rb") as f:
        scanner = secrets.Scanner(f.read())
    rng = random.Random(2)
    words = ["".join(rng.choices("0123456789abcdef", k=41)) for _ in range(20_000)]
    start = time.time()
    found = scanner.scan(" ".join(words))
    assert len(found) == 20_000 and time.time() - start < 20
    start = time.time()
    scanner.scan("".join(rng.choices(string.ascii_letters, k=1_000_000)))
    assert time.time() - start < 20

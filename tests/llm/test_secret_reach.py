"""Secrets of many parts, and target names far from their operators."""

import random
import time

import pytest
from tessera.llm import secret_scan

PARTS = [f"Zk{i:02d}Qx{81 * i + 7}_v" for i in range(40)]


def literals(text):
    return [text[a:b] for a, b, _ in secret_scan.lexed_spans(text)]


@pytest.mark.parametrize("text", [
    "k = " + " + ".join(f"'{p}'" for p in PARTS) + "\npassword = k\n",
    "k = ''\n" + "".join(f"k = k + '{p}'\n" for p in PARTS) + "password = k\n",
    "".join(f"k{i} = '{p}'\n" for i, p in enumerate(PARTS)) + "all = " + " + ".join(f"k{i}" for i in range(40)) + "\nclient_secret = all\n",
])
def test_all_parts_of_a_constant_are_found(text):
    assert literals(text) == PARTS


def test_pipeline_text_keeps_no_part(make):
    text = "k = " + " + ".join(f"'{p}'" for p in PARTS) + "\npassword = k\n"
    [row] = secret_scan.redact_secrets(make([(1, text)])).collect()
    assert not any(p in row["text"] for p in PARTS)


@pytest.mark.parametrize("name", ["password" + ".part" * 60, "secret->" + "x" * 400, "password" + " " * 500, "'password'" + " " * 500, "cfg['password'" + " " * 300 + "]"])
def test_names_are_read_to_their_start(name):
    assert literals(f"{name} = \"Qx81_77!zK\"") == ["Qx81_77!zK"]


def test_uses_of_a_long_constant_stay_cheap():
    text = "".join(f"token = token + 'Zk{i}Qx81_v'\n" for i in range(20_000))
    assert len(secret_scan.lexed_spans(text)) == 20_000


def test_scan_keeps_lexed_spans_that_no_base_span_covers():
    texts = ["password = 'hunter2hunter2'\nauth_key = 'Zk29Qx81_v!'\n" * 3, "k = 'deadbeefdeadbeefdeadbeef00'\npassword = k", "secret: 'Ab1_$x y9' token=abcdefgh"]
    for text in texts:
        base, every = secret_scan.scan(text)
        want = [s for s in secret_scan.lexed_spans(text) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)]
        assert sorted(set(every) - set(base)) == sorted(want)


def test_many_secrets_take_time_in_proportion():
    text = "".join(f"password = 'hunter{i}_hunter'\nclient_secret = \"Qx81_77!zK {i}\"\n" for i in range(30_000))
    began = time.perf_counter()
    assert len(secret_scan.scan(text)[1]) > 30_000
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "a=b.", "a=", "token=", "password=your-", "a.", "a.b=", "a::", "=\"", "='\\\"", "x + ", "k = k + 'a'\n", "set(", "]'", "token = token=", "a-b:", "`=", "${a}="])
def test_hostile_texts_take_time_in_proportion(unit):
    for text in (unit * (1_000_000 // len(unit)) + ":x", "x = " + unit * (1_000_000 // len(unit)) + "="):
        began = time.perf_counter()
        secret_scan.scan(text)
        assert time.perf_counter() - began < 20


def plain_assignments(text):
    """The same values, each read for itself from its operator on."""
    out = []
    for m in secret_scan._OPERATOR.finditer(text):
        value = secret_scan._VALUE.match(text, secret_scan._BLANK.match(text, m.end()).end())
        target = value and secret_scan._NAME_BACK.match(text[::-1], len(text) - m.start())
        if target:
            out.append((m.start(), (target[1] or target[2])[::-1], value.start(), value.end()))
    return out


def test_values_within_a_run_are_read_like_any_other():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "token", "=", ":", ".", " ", "+", "'", '"', "x9_", "\n", "->", "]", "-"]) for _ in range(rng.randint(2, 25)))
        got = secret_scan.assignments(text)
        want = sorted(plain_assignments(text))
        assert [name for name, _ in got] == [name for _, name, _, _ in want], text
        whole = [(a, b) for _, _, a, b in want]
        assert all(part == span for (_, parts), span in zip(got, whole, strict=True) for part in parts if not isinstance(part, int) and part[0] == span[0]), text

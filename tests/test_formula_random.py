"""Random formulas against Python's own evaluation."""

import math
import random

import pytest

from tabulane.functions.formula import formula

ROW = {"a": 7, "b": -3, "x": 2.5, "y": -0.75, "z": 0.0}
FUNCTIONS = {
    "clamp": lambda v, lo, hi: max(lo, min(hi, v)),
    "if_else": lambda c, t, e: t if c else e,
    "abs": abs,
    "min": min,
    "max": max,
    "floor": math.floor,
    "ceil": math.ceil,
    "sqrt": math.sqrt,
    "log": math.log,
    "exp": math.exp,
    "sin": math.sin,
    "cos": math.cos,
}


def number(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([*ROW, str(rng.randint(0, 9)), str(round(rng.uniform(0, 5), 2))])
    sub = lambda: number(rng, depth - 1)
    return rng.choice(
        [
            lambda: f"({sub()} {rng.choice(['+', '-', '*', '/', '//', '%'])} {sub()})",
            lambda: f"({sub()} {rng.choice(['+', '-', '*', '/', '//', '%'])} {sub()})",
            lambda: f"-{sub()}",
            lambda: f"{rng.choice(['abs', 'floor', 'ceil', 'sin', 'cos'])}({sub()})",
            lambda: f"{rng.choice(['min', 'max'])}({sub()}, {sub()})",
            lambda: f"clamp({sub()}, {rng.randint(-5, 0)}, {rng.randint(1, 5)})",
            lambda: f"({sub()} if {truth(rng, depth - 1)} else {sub()})",
            lambda: f"if_else({truth(rng, depth - 1)}, {sub()}, {sub()})",
            lambda: f"sqrt(abs({sub()}))",
            lambda: f"exp(clamp({sub()}, -3, 3))",
            lambda: f"log(abs({sub()}) + 1)",
        ]
    )()


def truth(rng, depth):
    a, b = number(rng, max(0, depth - 1)), number(rng, max(0, depth - 1))
    return rng.choice(
        [
            lambda: f"({a} {rng.choice(['<', '<=', '>', '>=', '==', '!='])} {b})",
            lambda: f"({a} < {b} <= {number(rng, 0)})",
            lambda: f"(not {a} > {b})",
            lambda: f"({a} > {b} and {b} < 3)",
            lambda: f"({a} > {b} or {a} < 1)",
        ]
    )()


def test_like_python(spark):
    rng = random.Random(20)
    texts, wants = [], []
    while len(texts) < 240:
        text = number(rng, 3)
        try:
            want = eval(text, {"__builtins__": {}, **FUNCTIONS}, dict(ROW))  # noqa: S307
        except ZeroDivisionError:
            continue
        if len(text) < 400 and abs(want) < 1e12:
            texts.append(text)
            wants.append(float(want))
    row = spark.createDataFrame([tuple(ROW.values())], "a long, b long, x double, y double, z double")
    for start in range(0, len(texts), 60):
        block = texts[start : start + 60]
        got = row.select(*[formula(t, row).cast("double").alias(f"c{i}") for i, t in enumerate(block)]).first()
        for text, value, want in zip(block, got, wants[start:]):
            assert value == pytest.approx(want, rel=1e-9, abs=1e-9), text

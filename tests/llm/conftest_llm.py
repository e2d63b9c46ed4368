"""Helpers of the tests in this folder."""
import random

SYLLABLES = ["th", "er", "on", "an", "in", "ed", "re", "st", "ing", "ble", "ti", "ou", "ha", "ea"]


def words(rnd: random.Random, n: int) -> list[str]:
    return ["".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(words(rnd, n))

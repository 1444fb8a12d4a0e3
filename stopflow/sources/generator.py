"""Seeded synthetic stops by the model of exploration and preferential return."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .stops import COUNTRIES

#: P(new place) = RHO * k^-GAMMA after k places. Fixed values.
RHO, GAMMA = 0.6, 0.21
MONTH = 1735689600  # 2025-01-01


def _user(random: np.random.Generator, visits: int) -> list[tuple[int, int, int]]:
    """(place, start, end) of a person: new places, or old ones in proportion to past visits."""
    seen: list[int] = []
    at, out = MONTH + int(random.integers(0, 86400)), []
    for _ in range(visits):
        places = len(set(seen))
        if not places or random.random() < RHO * places**-GAMMA:
            place = places
        else:
            place = seen[int(random.integers(len(seen)))]
        seen.append(place)
        stay = int(np.clip(random.lognormal(8.0, 1.0), 300, 14400))
        out.append((place, at, at + stay))
        at += stay + int(np.clip(random.lognormal(6.8, 0.8), 300, 7200))
    return out


def stops(users: int = 100, seed: int = 42, groups: int = 4) -> pd.DataFrame:
    """Raw stops with user_group, for users in ten countries."""
    random = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        centre = random.uniform((-60, -150), (60, 150))
        spread = random.normal(0, 0.05, (400, 2))
        zone = int(round(centre[1] / 15)) * 3600
        for place, start, end in _user(random, int(random.integers(20, 300))):
            lat, lon = centre + spread[place % 400]
            rows.append((f"{u % groups:02d}-{u:03d}", place, start, end, lat, lon, zone, f"{u % groups:02d}"))
    return pd.DataFrame(rows, columns=["useruuid", "loc", "start", "end", "latitude", "longitude", "timezone", "user_group"])


def demographics(made: pd.DataFrame, seed: int = 42) -> pd.DataFrame:
    """A gender and a country for each user."""
    random = np.random.default_rng(seed)
    users = sorted(made["useruuid"].unique())
    country = random.choice(COUNTRIES, len(users))
    return pd.DataFrame({"useruuid": users, "gender": random.choice(["MALE", "FEMALE"], len(users)), "GID_0": country, "NAME_0": country})

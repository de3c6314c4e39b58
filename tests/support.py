"""What tests share."""

from __future__ import annotations

import os

import numpy as np

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def solid(h, w, rgba):
    g = np.zeros((h, w, 4), int)
    g[:] = rgba
    return g

"""Naming a colour by its nearest prototype."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colour prototypes (red, green, blue), in the order that decides between equals.
PROTOTYPES = {
    "black": (20, 20, 20),
    "white": (235, 235, 235),
    "gray": (128, 128, 128),
    "red": (210, 50, 50),
    "green": (50, 170, 70),
    "blue": (60, 90, 210),
    "yellow": (220, 210, 60),
    "orange": (230, 140, 50),
    "pink": (220, 90, 170),
    "purple": (140, 80, 180),
    "brown": (130, 90, 60),
}
#: Pixels as bright as these or beyond are left out, if more than MANY remain.
DARK, LIGHT, MANY = 15, 245, 100
#: Images are averaged down to a square of this many pixels a side.
SIDE = 64


def nearest_color(red: Column, green: Column, blue: Column) -> Column:
    """The prototype at the least squared distance, the first of equals; null if a channel is."""
    far = lambda p: (red - p[0]) * (red - p[0]) + (green - p[1]) * (green - p[1]) + (blue - p[2]) * (blue - p[2])
    each = [F.struct(far(p).alias("d"), F.lit(k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(PROTOTYPES.items())]
    return F.when(red.isNotNull() & green.isNotNull() & blue.isNotNull(), F.array_min(F.array(*each))["name"])


def is_kept(red: Column, green: Column, blue: Column) -> Column:
    bright = (red + green + blue) / F.lit(3.0)
    return (bright > DARK) & (bright < LIGHT)

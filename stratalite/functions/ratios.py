"""Band ratios: a catalogue of formulas over bands B0, B1, ..., and their forms for each sensor."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .formula import formula

# The published ratios in ASTER band numbers (B0 stands for a blue band), each with its label.
CATALOGUE = """
(B7+B9)/B8 carbonate chlorite epidote
(B6+B9)/(B7+B8) epidote chlorite amphibole
(B6+B9)/B8 amphibole MgOH
B6/B8 amphibole
(B6+B8)/B7 dolomite
B13/B14 carbonate
B2/B1 Ferric Iron Fe3+
B2/B0 Iron Oxide
B5/B3+B1/B2 Ferrous Iron Fe2+
B4/B5 Laterite or Alteration
B4/B2 Gossan
B5/B4 Ferrous Silicates (biotite, chloride, amphibole)
B4/B3 Ferric Oxides (can be ambiguous)
(B5+B7)/B6 sericite muscovite illite smectite
(B4+B6)/B5 alunite kaolinite pyrophyllite
B5/B6 phengitic or host rock
B7/B6 muscovite
B7/B5 kaolinite
(B5*B7)/(B6*B6) clay
B14/B12 quartz
B12/B13 basic degree index (gnt cpx epi chl) or SiO2
B13/B12 SiO2 same as B14/B12
(B11*B11)/(B10*B12) siliceous rocks
B11/B10 silica
B11/B12 silica
B13/B10 silica
B3/B2 Vegetation
(B3-B2)/(B3+B2) NDVI
(B3-B4)/(B3+B4) NDWI/NDMI water in leaves
(B1-B3)/(B1+B3) NDWI water bodies
2.5*(B3-B2)/(B3+6.0*B2-7.5*B0+1) EVI
B3/B1 GRVI
(B3-B2)/sqrt(B3+B2) RDVI
1.5*(B3-B2)/(B3+B2+0.5) SAVI
B3A/B1 GRVI Landslide
(B3A-B2)/sqrt(B3A+B2A) RDVI Landslide
1.5*(B3-B2)/(B3+B2A+0.5) SAVI Landslide
0.5*(2*B3+1-sqrt((2*B3+1)**2-8*(B3-B2))) MSAVI2
(B3A-B4+B5)/(B3A+B4-B5) NMDI
((B4+B2)-(B3+B0))/((B4+B2)+(B3+B0)) BSI
B5/B3 Used in colour composites
B4/B0 Used in colour composites
B5/B1 Used in colour composites
B4/B7 Used in colour composites
B12/B14 Used in colour composites
B3/B4 Used in colour composites
B0,B1,B2,B3,B4 Landslide Index
""".strip().splitlines()

# The band of each sensor that stands for a band of the catalogue.
SENSORS = {
    "ASTER": {"B1": "B1", "B2": "B2", "B3": "B3", "B4": "B4", "B5": "B5", "B6": "B6", "B7": "B7", "B8": "B8", "B9": "B9", "B10": "B10", "B11": "B11", "B12": "B12", "B13": "B13", "B14": "B14", "B2A": "B2", "B3A": "B3"},
    "Landsat 8 and 9 (OLI)": {"B0": "B2", "B1": "B3", "B2": "B4", "B3": "B5", "B4": "B6", "B5": "B7", "B2A": "B4", "B3A": "B5"},
    "Landsat 7 (ETM+)": {"B0": "B1", "B1": "B2", "B2": "B3", "B3": "B4", "B4": "B5", "B5": "B7", "B2A": "B3", "B3A": "B4"},
    "Landsat 4 and 5 (TM)": {"B0": "B1", "B1": "B2", "B2": "B3", "B3": "B4", "B4": "B5", "B5": "B7", "B2A": "B3", "B3A": "B4"},
    "Sentinel-2": {"B0": "B2", "B1": "B3", "B2": "B4", "B3": "B8", "B4": "B11", "B5": "B12", "B2A": "B5", "B3A": "B8A"},
    "WorldView": {"B0": "B2", "B1": "B3", "B2": "B5", "B3": "B7", "B2A": "B5", "B3A": "B7"},
    "Unknown": {},
}
_BAND = re.compile(r"B\d+[A-Z]?")


def landsat_sensor(file: str) -> str:
    """Which Landsat generation a product's name tells of."""
    return "Landsat 8 and 9 (OLI)" if "LC08" in file or "LC09" in file else "Landsat 7 (ETM+)" if "LE07" in file else "Landsat 4 and 5 (TM)"


def for_sensor(sensor: str, catalogue: list[str] = CATALOGUE) -> list[tuple[str, str]]:
    """(formula, label) of the ratios whose bands the sensor has, in its own band names."""
    bands = SENSORS[sensor]
    parts = [entry.split(" ", 1) for entry in catalogue]
    return [(_BAND.sub(lambda m: bands[m[0]], text), label) for text, label in parts if all(b in bands for b in _BAND.findall(text))]


def ratio(text: str) -> Column:
    """The formula as a column over the bands it names; null where it divides by zero."""
    return formula(text, lambda name: F.col(f"`{name}`").cast("double")).cast("double")


def with_ratios(cells: DataFrame, sensor: str, catalogue: list[str] = CATALOGUE) -> DataFrame:
    """Adds ``r1, r2, ...``: each ratio of the catalogue that the sensor's bands allow, but for colour composites of several bands."""
    formulas = [f for f, _ in for_sensor(sensor, catalogue) if "," not in f]
    return cells.withColumns({f"r{i}": ratio(f) for i, f in enumerate(formulas, 1)})


def by_wavelength(text: str, wavelengths: dict[str, float]) -> str:
    """A formula over wavelengths (``R650``, nanometres) in terms of the bands nearest to them, the first of equally near ones."""
    return re.sub(r"R(\d+)", lambda m: min(wavelengths, key=lambda b: abs(wavelengths[b] - float(m[1]))), text)


def landslide_colours(ndvi: Column, ndwi: Column, swir: Column, bsi: Column) -> dict[str, Column]:
    """Red, green and blue of the landslide index: water before vegetation before bare or moist ground before soil."""
    water, plants, bare = ndwi > 0.15, ndvi > 0.25, (swir > 0.8) | (ndvi < 0.15)
    first = lambda a, b, c, d: F.when(water, a).when(plants, b).when(bare, c).otherwise(d)
    zero = F.lit(0.0)
    return {"red": first(zero, zero, F.lit(1.5), 3.5 * bsi), "green": first(F.lit(0.2), 0.2 * ndvi, F.lit(0.7), F.lit(0.3)), "blue": first(ndwi, zero, F.lit(-1.0), zero)}

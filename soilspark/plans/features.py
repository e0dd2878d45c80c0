"""Families and display names of features."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: families of features by the form of their names
FAMILIES = {
    "embedding": r"^(e|A)\d{2}$",
    "landsat": r"^(B\d+|nd|nw|evi|gi)_(mean|stdDev)_(gs|\d)$",
    "climate": r"^(pr|eto|tmmn|tmmx|tmean)_(mean|stdDev)",
    "radar": r"^(VV|VH|VH_VV)_(mean|stdDev)$",
    "moisture": r"^sm_",
    "soil": r"^(clay|sand|silt|bdod|soc|phh2o|cfvo|nitrogen)_",
    "terrain": r"^(elevation|slope|aspect|tpi)",
    "location": r"^(lat|lon)$",
}

# fixed values: display names of the parts of feature names
BANDS = {
    "B2": "Landsat B2 (blue)", "B3": "Landsat B3 (green)", "B4": "Landsat B4 (red)", "B5": "Landsat B5 (NIR)", "B6": "Landsat B6 (SWIR1)", "B7": "Landsat B7 (SWIR2)", "B10": "Landsat B10 (thermal)",
    "nd": "NDVI", "nw": "NDWI", "evi": "EVI", "gi": "Green Index",
}
STATISTICS = {"stdDev": "std dev", "sd": "std dev"}
QUARTERS = {"gs": "growing season", "1": "Q1", "2": "Q2", "3": "Q3", "4": "Q4"}
CLIMATE = {"pr": "precipitation", "eto": "ET0", "tmmn": "tmin", "tmmx": "tmax", "prec": "precipitation"}
NORMALS = {"ppt": "precipitation", "tdmean": "dewpoint mean", "vpdmin": "vpd min", "vpdmax": "vpd max"}
MOISTURE = {"sm_surface": "Surface soil moisture", "sm_rootzone": "Rootzone soil moisture", "sm_profile": "Profile soil moisture", "surface_temp": "Surface temperature", "leaf_area_index": "Leaf area index"}
LAYERS = {"bdod": "bulk density", "cec": "CEC", "cfvo": "coarse fragments", "phh2o": "pH H2O", "soc": "SOC", "ocd": "OCS density", "ocs": "OCS"}
PROPERTIES = {"bd": "bulk density", "ksat": "Ksat", "n": "van Genuchten n", "om": "organic matter", "ph": "pH"}
HALVES = {"am": "AM", "pm": "PM"}
NAMED = {
    "eto_yearly_mean": "Global ET0 yearly (mean)", "eto_yearly_sd": "Global ET0 yearly (std dev)", "lon": "Longitude", "lat": "Latitude", "elevation": "Elevation", "slope": "Slope", "aspect": "Aspect",
    "tpi_10000": "Topographic position index (10 km)", "tpi_22500": "Topographic position index (22.5 km)", "gsw": "Global surface water presence", "c3s_lccs_class_mode": "C3S LCCS class (mode)",
    "glc10_lc": "FROM-GLC10 land cover", "nlcd": "NLCD land cover", "cdl_cultivated_mode": "CDL cultivated (mode)", "cdl_crop_mode": "CDL crop (mode)", "cdl_simple_crop_mode": "CDL simple crop (mode)",
    "us_lith": "US lithology", "HWSD2_ID": "HWSD v2 soil unit ID", "WISE30s_ID": "WISE30s soil unit ID", "COVERAGE": "HWSD v2 coverage fraction", "SHARE": "HWSD v2 soil share", "WRB4": "WRB4 soil class",
    "WRB_PHASES": "WRB phases", "WRB2_CODE": "WRB2 soil code", "FAO90": "FAO 1990 soil unit", "KOPPEN": "K\u00f6ppen climate class", "TEXTURE_USDA": "USDA soil texture class",
    "REF_BULK_DENSITY": "Reference bulk density", "BULK_DENSITY": "Bulk density", "DRAINAGE": "Soil drainage class", "ROOT_DEPTH": "Rooting depth", "AWC": "Available water capacity",
}
# fixed values: what a name looks like, its label, and how each of its parts (the groups) is shown
PATTERNS = [
    (r"^(B2|B3|B4|B5|B6|B7|B10|nd|nw|evi|gi)_(mean|stdDev)_(gs|[1234])$", "{} {} ({})", (BANDS, STATISTICS, QUARTERS)),
    (r"^(pr|eto|tmmn|tmmx|tmean)_(mean|stdDev)_(winter|spring|summer|autumn)$", "gridMET {} {} ({})", (CLIMATE, STATISTICS, {})),
    (r"^(VV|VH|VH_VV)_(mean|stdDev)$", "Sentinel-1 {} {}", ({}, STATISTICS)),
    (r"^vegetation_water_content_(am|pm)_(mean|stdDev)$", "SMAP L3 VWC ({}) {}", (HALVES, STATISTICS)),
    (r"^(sm_surface|sm_rootzone|sm_profile|surface_temp|leaf_area_index)_(mean|stdDev)$", "SMAP L4 {} {}", (MOISTURE, STATISTICS)),
    (r"^(bdod|cec|cfvo|clay|sand|silt|nitrogen|phh2o|soc|ocd|ocs)_(\d+-\d+cm)_(mean|stdDev|sd)$", "SoilGrids {0} {2} ({1})", (LAYERS, {}, STATISTICS)),
    (r"^wc_(prec|tavg|tmin|tmax)_(winter|spring|summer|autumn)$", "WorldClim {} ({})", (CLIMATE, {})),
    (r"^eto_(winter|spring|summer|autumn)$", "Global ET0 ({})", ({},)),
    (r"^(bdod|cec|cfvo|clay|sand|silt|nitrogen|phh2o|soc|ocd|ocs)_mean$", "SoilGrids {} (mean)", (LAYERS,)),
    (r"^(bd|ksat|n|om|ph|theta_r|theta_s|lambda|hb|alpha)_mean$", "POLARIS {} (mean)", (PROPERTIES,)),
    (r"^ssurgo_(awc|clay|ksat|sand)$", "SSURGO {}", ({},)),
    (r"^(ppt|tmin|tmax|tmean|tdmean|vpdmin|vpdmax)$", "PRISM normals 1991\u20132020 {}", (NORMALS,)),
    (r"^embedding_0*(\d+)$", "Google Satellite Embedding {}", ({},)),
    (r"^e0*(\d+)$", "Site embedding {}", ({},)),
    (r"^A0*(\d+)$", "AlphaEarth Foundations Satellite Embedding {}", ({},)),
]


def family(name: str) -> str:
    return next((k for k, p in FAMILIES.items() if re.match(p, name)), "other")


def without(columns: list[str], families: tuple[str, ...]) -> list[str]:
    return [c for c in columns if family(c) not in families]


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key) if table else key


def label(name: Column) -> Column:
    """The display name of a feature; the name itself if nothing is known of it."""
    shown = F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMED.items() for x in kv]), name)
    for pattern, form, tables in PATTERNS:
        parts = [_looked_up(t, F.regexp_extract(name, pattern, k)) for k, t in enumerate(tables, 1)]
        text, pieces = re.split(r"\{\d?\}", form), [int(i) if i else n for n, i in enumerate(re.findall(r"\{(\d?)\}", form))]
        whole = F.concat(F.lit(text[0]), *[x for k, t in zip(pieces, text[1:], strict=True) for x in (parts[k], F.lit(t))])
        shown = F.coalesce(shown, F.when(name.rlike(pattern), whole))
    return F.coalesce(shown, F.when(name.startswith("hhs_"), F.concat(F.lit("HiHydroSoil v2 "), F.translate(F.substring(name, F.lit(5), F.char_length(name)), "_", " "))), name)

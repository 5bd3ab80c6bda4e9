"""Explicit schemas of the input tables."""

from pyspark.sql import types as T

_TYPES = {
    "long": T.LongType,
    "int": T.IntegerType,
    "double": T.DoubleType,
    "string": T.StringType,
}


def _struct(text: str) -> T.StructType:
    pairs = (field.split(":") for field in text.split())
    return T.StructType([T.StructField(n, _TYPES[t](), True) for n, t in pairs])


# Cleaned observations, column order as in the exchanged CSV files.
PLANTS = _struct(
    "site_id:long lat:double lon:double elev:double state:string common_name:string "
    "species_id:long func_type:string id:long phenophase:string pheno_class_id:int "
    "year:int first_yes:int prior_no:int"
)
ANIMALS = _struct(
    "site_id:long lat:double lon:double elev:double state:string common_name:string "
    "species_id:long func_type:string phenophase_category:string phenophase:string "
    "pheno_class_id:int year:int first_yes:int prior_no:int"
)
AUTUMN = _struct(
    "site_id:long lat:double lon:double elev:double state:string common_name:string "
    "species_id:long func_type:string id:long phenophase_id:int phenophase:string "
    "year:int first_yes:int prior_no:int"
)
OBSERVATIONS = {"plants": PLANTS, "animals": ANIMALS, "autumn": AUTUMN}

# Dimension tables.
PHASE_CLASSES = _struct("id:int name:string")
PHENOPHASES = _struct(
    "phenophase_id:int phenophase_name:string phenophase_category:string pheno_class_id:int"
)
SPECIES = _struct("species_id:long common_name:string class_id:int kingdom:string")
LAYERS = _struct("name:string title:string abstract:string dimension_name:string")

# Geometry and grids as plain tables.
VERTICES = _struct("poly_id:string ring_id:int seq:int x:double y:double")
CELLS = _struct("row:int col:int lon:double lat:double value:double")
SITE_ELEVATION = _struct("site_id:long elevation:double")
COUNTY_KEYS = _struct("STATEFP:string COUNTYFP:string state:string county:string")


def county_index(years) -> T.StructType:
    """Wide county table; the two code columns stay text."""
    fields = list(COUNTY_KEYS.fields)
    fields += [T.StructField(f"doy_{y}", T.DoubleType(), True) for y in years]
    return T.StructType(fields)

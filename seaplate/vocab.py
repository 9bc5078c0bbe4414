"""Names, codes, caps and mappings that results depend on."""

# Catch attributes.
BOTTOM_TRAWL = "bottom trawl"
INDUSTRIAL = "Industrial"
HUMAN_CONSUMPTION = "Direct human consumption"
FISHMEAL = "Fishmeal and fish oil"
DISCARDS = "Discards"
END_USES = [HUMAN_CONSUMPTION, DISCARDS, FISHMEAL]
REPORTED = "Reported"
UNREPORTED = "Unreported"
FLEET_RENAMES = {"Côte d'Ivoire": "Ivory Coast"}

# Assay selection and the short report names of the seven nutrients.
ASSAY_PREPARATIONS = ["raw", "frozen", "small sample"]
ASSAY_PARTS = ["muscle tissue", "edible", "raw", "small sample"]
ASSAY_NUTRIENTS = [
    "Iron, total",
    "Zinc",
    "Calcium",
    "Total fatty acids, polyunsaturated",
    "Protein, total; calculated from total nitrogen",
    "Vitamin A; sum of retinol/carotenoids",
    "Vitamin B12",
]
NUTRIENT_NAMES = {
    "Iron, total": "Iron",
    "Protein, total; calculated from total nitrogen": "Protein",
    "Total fatty acids, polyunsaturated": "DHA+EPA",
    "Vitamin A; sum of retinol/carotenoids": "Vitamin A, RAE",
}
SUPPLY_NUTRIENTS = ["Calcium", "DHA+EPA", "Iron", "Protein", "Vitamin A, RAE", "Vitamin B12", "Zinc"]
REPORT_NUTRIENTS = ["Calcium", "DHA+EPA", "Iron", "Vitamin A", "Vitamin B12", "Zinc"]

# Class words that stand for another class name.
GENUS_SYNONYMS = {"osteichthyes": "actinopterygii", "elasmobranchii": "chondrichthyes"}

# Composition is per 100 g; tonnes to 100 g portions.
PORTIONS_PER_TONNE = 10 * 1000
DAYS_PER_YEAR = 365

# Food balance.
BALANCE_COLUMNS = {
    "OUTPUT,0": "output",
    "...2": "iso3c",
    "...3": "food_abrev",
    "...4": "nutrient",
}
BALANCE_NUTRIENTS = {
    "CA": "Calcium",
    "FE": "Iron",
    "MFAT": "Monounsaturated fatty acids",
    "O3": "Omega-3 fatty acids",
    "PFAT": "Polyunsaturated fatty acids",
    "SFAT": "Saturated fatty acids",
    "TFAT": "Fat",
    "VitA1": "Vitamin A",
    "VitB": "Vitamin B12",
    "ZN": "Zinc",
    "PROT": "Protein",
    "DES": "Calories",
}
BALANCE_SCOPE = ["Iron", "Zinc", "Protein", "Vitamin A", "Vitamin B12", "Omega-3 fatty acids", "Calcium"]
BLOC = "EUN"
WORLD = "WLD"
DISSOLVED_MEMBER = "Czechoslovakia"
PRODUCT_SECTORS = {
    "Fish": "Fish",
    "Beef and Veal": "ASF",
    "Eggs": "ASF",
    "Pork": "ASF",
    "Poultry": "ASF",
    "Sheep": "ASF",
    "Butter": "ASF",
    "Milk": "ASF",
    "Fruits and vegetables": "Other",
    "Other Coarse Grains": "Other",
    "Other Oilseeds": "Other",
    "#N/A": "Other",
    "Pulses": "Other",
    "Sugar": "Other",
    "Rice": "Other",
    "Vegetable oils": "Other",
    "Maize": "Other",
    "Wheat": "Other",
    "Roots tubers": "Other",
}

# Display names of dissolved or grouped country codes.
GROUPED_COUNTRIES = {
    "ANT": "Netherlands Antilles",
    "BLX": "Belgium-Luxembourg",
    "CZ2": "Czechoslovakia",
    "ET2": "Ethiopia PDR",
    "EUN": "EU 27",
    "SRM": "Serbia and Montenegro",
    "USR": "USSR",
    "YUG": "Yugoslav SFR",
}

# Demography: age code of each age group, sex code of each sex.
AGE_CODES = {
    "0-4": 5,
    "5-9": 6,
    "10-14": 7,
    "15-19": 8,
    "20-24": 9,
    "25-29": 10,
    "30-34": 11,
    "35-39": 12,
    "40-44": 13,
    "45-49": 14,
    "50-54": 15,
    "55-59": 16,
    "60-64": 17,
    "65-69": 18,
    "70-74": 19,
    "75-79": 20,
    "80-84": 30,
    "85-89": 31,
    "90-94": 32,
    "95-99": 33,
}
AGES_OVER_80 = ["80-84", "85-89", "90-94", "95-99"]
SEX_CODES = {"Males": 1, "Females": 2}
RISK_FREE_AGES = [5, 6, 7, 8, 9]

# Names of scenarios and nutrients from table to table.
SCENARIO_NAMES = {"base": "Base", "high": "High road"}
INTAKE_NUTRIENTS = {"Vitamin A": "Vitamin A, RAE", "Vitamin B12": "Vitamin B-12"}
SCALAR_NUTRIENTS = {"Energy": "Calories", "Total lipids": "Fat", "Vitamin A, RAE": "Vitamin A"}
REPORT_NAMES = {"Omega-3 fatty acids": "DHA+EPA", "Vitamin A, RAE": "Vitamin A", "Vitamin B-12": "Vitamin B12"}

# Exposure.
SEV_NUTRIENTS = ["Zinc", "Iron", "Calcium", "Vitamin A, RAE", "Vitamin B-12"]
OMEGA3 = "Omega-3 fatty acids"
SURVEY_SCALAR_NUTRIENTS = ["Omega-3 fatty acids", "Vitamin B-12"]
LOW_TAIL = 1e-4
HIGH_TAIL = 0.9999
TAIL_Z = 3.719016485
REQUIREMENT_COLUMNS = {
    ("Iron", "low"): "Iron.5%",
    ("Iron", "middle"): "Iron.10%",
    ("Iron", "high"): "Iron.12%",
    ("Zinc", "low"): "Zinc.low",
    ("Zinc", "middle"): "Zinc.mod",
    ("Zinc", "high"): "Zinc.high",
    ("Vitamin A, RAE", None): "VitA",
    ("Vitamin B-12", None): "B12",
    ("Calcium", None): "Calcium",
}
REQUIREMENT_CV = {"Vitamin B-12": 0.25}
DEFAULT_CV = 0.1
OMEGA_END_KNOTS = ((-0.2, 1.0), 6.0)
MEAT_END_KNOTS = ((-200.0, 1.0), 1000.0)
MEAT_INTAKES = [0.0, 50.0, 100.0, 150.0, 200.0]
MEAT_OUTCOMES = {
    "Breast cancer": 429,
    "Colon and rectum cancer": 441,
    "Ischemic heart disease": 493,
    "Ischemic stroke": 495,
    "Intracerebral hemorrhage": 496,
    "Subarachnoid hemorrhage": 497,
    "Diabetes mellitus type 2": 976,
}

# Report caps.
METRIC_CAPS = {
    "perc_ASF": {"Calcium": 5, "DHA+EPA": 50, "Vitamin A": 10, "Zinc": 5, "Vitamin B12": 10, "Iron": 10},
    "perc_tot": {"Calcium": 3, "DHA+EPA": 3, "Vitamin A": 2, "Zinc": 2, "Vitamin B12": 3, "Iron": 2},
    "perc_fish": {"Calcium": 30, "DHA+EPA": 30, "Vitamin A": 30, "Zinc": 30, "Vitamin B12": 30, "Iron": 30},
}
RATIO_CAPS = {"discard_ratio": 2.5, "reporting_ratio": 10.0}
TINY_AREA_SQKM = 10.0
SMALL_AREA_SQKM = 25000.0

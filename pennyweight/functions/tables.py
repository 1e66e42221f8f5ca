"""Fixed values of the published rules: word lists, patterns, labels and limits.

Everything here is data that results depend on; the rules that use it are
in the other modules.
"""

from __future__ import annotations

# Spellings of public bodies, in order; the first that is found names the body.
BODIES = [
    (r"hydro\b", "Newfoundland and Labrador Hydro"),
    (r"^(nl|newfoundland (and|&) labrador) (centre|center) for health info|\(nl centre for health information\)", "NL Centre for Health Information"),
    (r"nl hea?lth services?|newfoundland (and|&) labrador health services|nl health service\b|nl heath", "NL Health Services"),
    (r"^eastern (regional )?health|^eastern regional health authority", "Eastern Health (regional health authority)"),
    (r"^central (regional )?health", "Central Health (regional health authority)"),
    (r"^western (regional )?health", "Western Health (regional health authority)"),
    (r"labrador.?grenfell", "Labrador-Grenfell Health (regional health authority)"),
    (r"regional health authorities", "Regional health authorities (joint)"),
    (r"public procur[a-z]* agn?e[a-z]*cy|public procurment agency|^ppa$", "Public Procurement Agency"),
    (r"chief information officer|^ocio$|-ocio", "Office of the Chief Information Officer"),
    (r"liquor corp|^nlc$", "NL Liquor Corporation"),
    (r"oil ?co\b|oil and gas corporation", "Oil and Gas Corporation of NL"),
    (r"transportation (and|&) (infrastructure|infrastru|works)", "Department of Transportation and Infrastructure"),
    (r"^(department of )?education (and|&) early childhood", "Department of Education and Early Childhood Development"),
    (r"^(department of )?education$", "Department of Education"),
    (r"^(department of )?fisheries, forestry (and|&) (agriculture|aquaculture)", "Department of Fisheries, Forestry and Agriculture"),
    (r"^(department of )?industry, energy (and|&) technology", "Department of Industry, Energy and Technology"),
    (r"^(department of )?tourism, culture,? arts,? (and|&) recreation|^tourism, culture (and|&) recreation", "Department of Tourism, Culture, Arts and Recreation"),
    (r"^(department of )?justice (and|&) public safety", "Department of Justice and Public Safety"),
    (r"^(department of )?finance$", "Department of Finance"),
    (r"^(department of )?executive council$|^executive council, office of the chief executive", "Executive Council"),
    (r"^(department of )?digital government", "Department of Digital Government and Service NL"),
    (r"^(department of )?environment (and|&) climate change", "Department of Environment and Climate Change"),
    (r"^(department of )?health (and|&) community services", "Department of Health and Community Services"),
    (r"english school district|nlesd", "Newfoundland and Labrador English School District"),
    (r"college of the north atlantic", "College of the North Atlantic"),
    (r"^(the )?city of st\.? john", "City of St. John's"),
    (r"^(the )?town of gander", "Town of Gander"),
    (r"nalcor", "Nalcor Energy"),
    (r"labrador island link|^lil lp", "Labrador Island Link LP"),
    (r"^(department of )?labrador affairs", "Labrador Affairs"),
    (r"royal newfoundland constabulary", "Royal Newfoundland Constabulary"),
]
NO_BODY = "Public body not named"

# Clauses of the exceptions to an open call, in order.
CLAUSES = [
    (r"6\s*\(?a?\)?\s*\(?v\)?(?!i)|only (one |available )?source|one source", "Sole source"),
    (r"6\s*\(?a?\)?\s*\(?iv\)?|emergenc|urgen", "Emergency"),
    (r"6\s*\(?a?\)?\s*\(?vii\)?|resale", "For resale"),
    (r"6\s*\(?a?\)?\s*\(?vi\)?|pre.?qualified", "Pre-qualified supplier"),
    (r"6\s*\(?a\)?\s*\(?ii\)?|security", "Security"),
    (r"6\s*\(?b\)?|PUB", "Rates set by regulator"),
]

# Limits for an open call by type of body, and the patterns of the types.
LIMITS = {
    "department": [(34_700, "goods"), (100_000, "leases of space"), (139_000, "services and public works")],
    "local": [(100_000, "leases of space"), (139_000, "goods and services"), (347_400, "public works")],
    "crown": [(100_000, "leases of space"), (264_200, "goods, services and public works")],
}
LOCAL_BODY = r"^(city|town) of|health services|health authorit|regional health|eastern health|central health|western health|labrador-grenfell|centre for health information|school district|conseil scolaire|memorial university|college of the north atlantic"
CROWN_BODY = r"hydro|nalcor|liquor|oil and gas|housing corporation|marble mountain|film development|workplacenl|workplace health|bull arm|labrador island link|research and development|c\.a\. pippy|the rooms|arts council|municipal assessment|tourism board"

# What stands before the name of a department.
DEPARTMENT_PREFIX = r"^(the )?(department of|dept\.? of|office of the|office of)\s+"

# Spellings of the country and the province, letters of postal codes, cities elsewhere.
COUNTRY = ("", "ca", "can", "canada")
PROVINCES = ("nl", "newfoundland and labrador", "newfoundland & labrador", "newfoundland & labr.", "terre-neuve-et-labrador")
POSTAL_CODE = r"[ABCEGHJ-NPRSTVXY]\d[ABCEGHJ-NPRSTV-Z](?:\s?\d[ABCEGHJ-NPRSTV-Z]\d)?"
OUTSIDE_CITIES = ("winnipeg", "regina", "toronto", "ottawa", "halifax", "vancouver", "calgary", "edmonton", "montreal", "montréal")

# Delivery regions in the province, and wider ones.
LOCAL_REGIONS = ("Newfoundland and Labrador", "Terre-Neuve-et-Labrador")
BROADER_REGIONS = (
    "Canada", "Ontario (except NCR)", "Quebec (except NCR)", "National Capital Region (NCR)", "Nova Scotia", "New Brunswick", "Prince Edward Island", "British Columbia",
    "Alberta", "Saskatchewan", "Manitoba", "Yukon", "Northwest Territories", "Nunavut Territory", "Ireland", "Prescott",
)

# Names that stand for no name, and words of places, units, kinds and generic names.
PLACEHOLDERS = ("n a", "na", "none", "null", "not applicable", "sans objet", "s o", "unknown", "inconnu")
PROVINCE_TAILS = ("newfoundland and labrador", "newfoundland", "labrador", "nl")
PLACE_WORDS = "newfoundland labrador and of the nl terre neuve et du de la".split()
UNIT_WORDS = "department dept ministere faculty school campus institute division branch secretariat".split()
KIND_WORDS = "solutions systems technologies technology enterprises holdings industries union incorporated society association services group organization".split()
GENERIC_WORDS = (
    "newfoundland labrador nl and of the for de du la le les et des st saint johns canada canadian government gouvernement province provincial department ministere "
    "town ville city cite municipality council association society centre center club inc first nation nations band community group services service foundation fondation "
    "board committee regional region north south east west western eastern northern southern central atlantic international national"
).split()

# Descriptions that say nothing about what was bought.
VAGUE_DESCRIPTIONS = (
    "services", "service", "goods", "supplies", "consulting", "consulting services", "professional services", "equipment", "materials", "various", "misc", "miscellaneous",
    "parts", "repairs", "maintenance", "software",
)

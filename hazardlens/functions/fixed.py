"""Names, thresholds, patterns and word lists that results depend on."""

#: The nine rules, in display order.
RULES = [
    "Bypassing Safety Controls", "Confined Space", "Driving", "Energy Isolation", "Hot Work",
    "Line of Fire", "Safe Mechanical Lifting", "Work Authorisation", "Working at Height",
]
ENTITY_TYPES = ["activity", "location", "equipment", "barrier_failure"]
ROLES = ["worker", "supervisor", "hse_officer"]

CONFIDENCE_THRESHOLD = 0.65
MAX_REPORT_CHARS = 20000
Z = 1.96
SIMILARITY_THRESHOLD = 0.85
CONFIDENCE_FLOOR = 0.5
MIN_SPELLCHECK_LENGTH = 4
MAX_SPELLCHECK_CANDIDATES = 4
POS_WEIGHT_CAP = 10
MIN_VOCABULARY_COUNT = 2
MAX_ACTIVITY_TOKENS = 12
EXCERPT_CHARS = 180

#: Labelling rule: events left out, and the tests for serious potential.
EXCLUDE_EVENT = [
    "shooting", "stabbing", "hitting kicking beating", "injury by other person", "object held or wielded by person",
    "self harm", "animal", "bites", "stings", "venomous", "assault", "restraining subduing",
]
FALL = ["fall to lower level", "fall through surface", "jump to lower level"]
LOW_FALL = "less than 6 feet"
HIGH_ENERGY = [
    "falling object", "object falling", "flying object", "struck by object or equipment", "struck by dislodged",
    "struck by discharged", "struck by swinging", "suspended or swinging", "struck by powered",
    "struck by object dropped by person", "struck by rolling sliding or shifting", "struck by running powered",
    "struck by object falling from vehicle", "falling part of", "falling powered vehicle", "electric", "collision",
    "pedestrian struck by", "pedestrian vehicular", "rolling powered vehicle", "run over by", "nonroadway noncollision",
    "roadway noncollision", "jack knifed or overturned", "ran off driving surface", "part of occupant s body caught",
    "caught in running", "caught entangled in running", "caught in or compressed by", "compressed or pinched by shifting",
    "compressed between running equipment", "explosion", "fire", "ignition", "collapse engulfment", "engulfment in",
    "cave in", "collapsing structure", "inhalation of harmful substance", "exposure to other harmful substance",
    "exposure to harmful substances", "oxygen", "submers", "drown",
]
BARRIER = ["curtailed by"]
LETHAL_NATURE = [
    "intracranial", "internal injur", "internal organs", "asphyxiation", "suffocat", "strangulat", "drown", "electrocution",
    "electric shock", "third or fourth degree", "spinal cord", "paralysis", "crushing", "multiple severe wounds",
    "hemorrhage", "multiple traumatic", "heat stroke",
]

#: Terms that name a control or its absence.
CONTROL_TERMS = [
    "ppe", "lock", "locks", "locked", "lockout", "loto", "tagout", r"isolat\w*", "guard", "guards", "guarded", "permit",
    "permits", "harness", "lanyard", r"barricade\w*", "handrail", "railing", "spotter", "banksman", r"interlock\w*",
    r"gas test\w*", "fall protection", "not secured", "unsecured", "without", "failed to", "did not", "was not", "no one",
    "never", "bina", "nahi", "nahin", "naa", "band", "khula", "khuli", "chalu", "lagaya", "lagayi", "kiya", "karna",
    "chahiye", "tha", "thi",
]
#: Words that say that a control is absent; missing barriers begin with one.
ABSENCE_WORDS = ["no", "not", "without", "missing", "miss", "nahi", "koi", "skip"]

#: Names: titles before them, and capitalised words that are none.
HONORIFICS = ["Mr", "Mrs", "Ms", "Mx", "Dr", "Shri", "Smt", "Sri"]
NOT_NAMES = [
    "Duliajan", "Naharkatiya", "Moran", "Baghjan", "Makum", "Hapjan", "Tanot", "Ramgarh", "The", "A", "An", "On", "At",
    "During", "While", "After", "Before", "He", "She", "They", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
    "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
    "November", "December",
]

#: Typographic characters and their ASCII forms.
TYPOGRAPHIC = "\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f\u2032\u2033\u00a0\u2007\u2009\u202f\u00ad"
PLAIN = "------" + "''''" + '""""' + "'" + '"' + "    "

#: Whole-word acronyms and what they stand for.
ACRONYMS = {
    "ppe": "personal protective equipment", "loto": "lockout tagout", "ptw": "permit to work", "jsa": "job safety analysis",
    "hse": "health safety and environment", "hira": "hazard identification and risk assessment",
    "hazop": "hazard and operability study", "msds": "material safety data sheet", "sds": "safety data sheet",
    "scba": "self contained breathing apparatus", "lel": "lower explosive limit", "h2s": "hydrogen sulphide",
    "co2": "carbon dioxide", "ert": "emergency response team", "sif": "serious injury or fatality",
    "lti": "lost time injury", "trir": "total recordable incident rate", "moc": "management of change",
    "tbt": "toolbox talk", "jha": "job hazard analysis", "hazid": "hazard identification",
    "simops": "simultaneous operations", "iogp": "international association of oil and gas producers",
    "lsr": "life saving rule", "flra": "field level risk assessment", "tra": "task risk assessment",
    "cse": "confined space entry", "wah": "work at height", "frc": "fire retardant clothing",
    "mpi": "magnetic particle inspection", "dpt": "dye penetrant test",
    "bop": "blowout preventer", "bha": "bottom hole assembly", "rih": "run in hole", "pooh": "pull out of hole",
    "wob": "weight on bit", "rop": "rate of penetration", "td": "total depth", "npt": "non productive time",
    "dp": "drill pipe", "csg": "casing", "tbg": "tubing", "wl": "wireline", "ct": "coiled tubing",
    "srp": "sucker rod pump", "esp": "electrical submersible pump", "pcp": "progressive cavity pump",
    "dg": "diesel generator", "dg set": "diesel generator set", "psv": "pressure safety valve",
    "prv": "pressure relief valve", "esdv": "emergency shutdown valve", "mawp": "maximum allowable working pressure",
    "whp": "wellhead pressure", "thp": "tubing head pressure", "chp": "casing head pressure",
    "sithp": "shut in tubing head pressure", "sicp": "shut in casing pressure", "ibop": "internal blowout preventer",
    "mgs": "mud gas separator", "octg": "oil country tubular goods", "lcm": "lost circulation material",
    "ecd": "equivalent circulating density", "dls": "dogleg severity", "tvd": "true vertical depth",
    "wbm": "water based mud", "obm": "oil based mud", "rkb": "rotary kelly bushing", "hpht": "high pressure high temperature",
    "ggs": "group gathering station", "ocs": "oil collecting station", "eps": "early production system",
    "cts": "central tank station", "ctf": "central tank farm", "ongc": "oil and natural gas corporation",
    "oisd": "oil industry safety directorate", "dgms": "directorate general of mines safety",
    "lpg": "liquefied petroleum gas", "cng": "compressed natural gas", "lng": "liquefied natural gas",
    "eqpt": "equipment", "eqp": "equipment", "mtr": "metre", "mtrs": "metres", "approx": "approximately", "hrs": "hours",
    "wrk": "work", "maint": "maintenance", "opr": "operator", "sup": "supervisor", "inj": "injury", "hosp": "hospital",
    "amb": "ambulance", "veh": "vehicle",
}

#: Words of the field that no dictionary of English holds, and names; never repaired.
DOMAIN_WORDS = [
    "drawworks", "workover", "monkeyboard", "kelly", "derrick", "tong", "tongs",
    "casing", "tubing", "wellhead", "christmas", "annulus", "swab", "swabbing",
    "sucker", "elevator", "elevators", "slips", "cellar", "flowline", "manifold",
    "separator", "knockout", "flare", "pigging", "rathole", "mousehole", "kickoff",
    "topdrive", "mudline", "shaker", "shakers", "desander", "desilter", "choke",
    "genset", "bullnose", "crossover", "nipple", "spool", "gasket", "bund",
    "khalasi", "khalasis", "toolpusher", "roustabout", "roughneck", "banksman",
    "rigger", "riggers", "fitter", "fitters", "jawan", "havildar", "sirdar", "contractual",
    "duliajan", "naharkatiya", "moran", "baghjan", "makum", "hapjan", "tanot",
    "ramgarh", "assam", "rajasthan", "dibrugarh", "tinsukia", "jaisalmer",
    "assamese", "brahmaputra",
    "ramesh", "suresh", "rajesh", "mahesh", "amit", "sunil", "anil", "vijay",
    "raju", "ravi", "mohan", "arun", "deepak", "sanjeev", "vinod", "ashok",
    "rakesh", "dinesh", "manoj", "pradeep", "sanjay", "ajay", "bikash", "dipak",
    "jitendra", "narayan", "gopal", "bharat", "kishore", "prakash", "hemant", "jwala",
]
#: Short forms that have more than one reading and are never expanded.
UNVERIFIED = ["dsv", "wd", "temp", "oim", "mop", "tt", "sh", "lt", "ht", "cp", "pm", "sop", "peso", "mw", "tds", "ut", "rt", "gl", "pob", "nmr", "swp"]
#: Words of Roman Hindi that are English words as well, which a lexicon must not map.
ENGLISH_LOOKALIKES = [
    "the", "do", "par", "se", "is", "to", "so", "ho", "le", "na", "hi", "us",
    "main", "mere", "more", "din", "are", "an", "in", "on", "at", "no", "be",
    "he", "it", "was", "were", "can", "man", "men", "may", "kar", "ki", "ka",
    "ko", "ke", "sab ko", "bad", "sat", "pat", "tan", "ban", "dam", "jam",
    "lag", "log", "log in", "aur", "ek", "sir", "pair", "mat", "wo", "jo", "band",
    "hone", "niche", "jab",
]
#: Keys of the lexicon that English also holds, reviewed and accepted.
REVIEWED_LOOKALIKES = ["agar", "bach", "bola", "gaya", "hui", "karo", "phat", "purana", "saab", "sab", "tut"]

#: Words around mined terms in the patterns of spans.
PREPOSITIONS = ["at", "in", "on", "near", "inside"]
ARTICLES = ["the", "a", "an"]
ABSENCE_PHRASES = ["nahi tha", "miss hua", "miss kar diya", "skip kiya", "nahi dikha"]

#: Sites that a new table begins with, and their regions.
SITES = [
    ("Duliajan", "Assam"), ("Naharkatiya", "Assam"), ("Moran", "Assam"), ("Baghjan", "Assam"), ("Makum", "Assam"), ("Hapjan", "Assam"),
    ("Tanot", "Rajasthan"), ("Ramgarh", "Rajasthan"),
]

"""Word lists and lookup tables of the normaliser (fixed values: results depend on each of them)."""

from __future__ import annotations

LEGAL = (
    "inc incorporated corp corporation co company companies llc l c ltd limited pvt private llp lp pllc plc pc pa na "
    "sa sas sasu sarl eurl sci snc ei cie ets scop sca gmbh ag bv nv pty opc holdco"
).split()
#: Legal words whose skeletons are legal too, in the spellings that transliteration gives.
LEGAL_SPELLINGS = "private limited praivet limitet piraivet elelpi pvt ltd llp llc inc corp corporation incorporated company sarl sasu eurl".split()
LEGAL_EXTRA = "pra li lt limi pvt prai praivet limited limitet elelpi elelsi inkarporated korp kampani kampni".split()
STOP = "the and of de du des la le les et a an at for d l en by to in on und".split()
HONORIFIC = "dr smt shri sri mr mrs ms m mme mlle the".split()
TITLES = "md do dds dmd dls dvm phd cpa esq rn np pa od dc jr sr ii iii iv".split()

#: Legal forms in order of priority, with the words that tell each.
LEGAL_KINDS = (
    ("llc", ("llc",)),
    ("llp", ("llp",)),
    ("inc", ("inc", "incorporated")),
    ("corp", ("corp", "corporation")),
    ("pvt", ("pvt", "private")),
    ("ltd", ("ltd", "limited")),
    ("sarl", ("sarl", "eurl")),
    ("sas", ("sas", "sasu")),
    ("sa", ("sa",)),
    ("lp", ("lp", "pllc", "plc", "pc")),
)

ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "ave": "avenue", "av": "avenue", "avn": "avenue",
    "blvd": "boulevard", "bd": "boulevard", "bld": "boulevard", "dr": "drive", "drv": "drive",
    "ln": "lane", "ct": "court", "crt": "court", "pl": "place", "plz": "plaza", "sq": "square",
    "pkwy": "parkway", "pky": "parkway", "hwy": "highway", "cir": "circle", "trl": "trail",
    "ter": "terrace", "terr": "terrace", "cres": "crescent", "expy": "expressway", "fwy": "freeway",
    "mt": "mount", "ft": "fort", "pt": "point", "apt": "apartment", "ste": "suite", "fl": "floor",
    "flr": "floor", "bldg": "building", "n": "north", "s": "south", "e": "east", "w": "west",
    "ne": "northeast", "nw": "northwest", "se": "southeast", "sw": "southwest",
    "r": "rue", "imp": "impasse", "all": "allee", "che": "chemin", "chem": "chemin", "rte": "route",
    "fbg": "faubourg", "qu": "quai", "ch": "chemin",
    "ngr": "nagar", "mkt": "market", "opp": "opposite", "nr": "near", "sec": "sector",
    "hno": "house", "h": "house", "no": "number", "num": "number", "dist": "district",
    "vill": "village", "vpo": "village", "po": "post", "ps": "police", "tq": "taluka", "tal": "taluka",
    "extn": "extension", "ext": "extension", "colny": "colony", "col": "colony", "chs": "society",
    "chsl": "society", "soc": "society", "hsg": "housing", "indl": "industrial", "ind": "industrial",
}
ADDRESS_WORDS_FRANCE = {"st": "saint", "ste": "sainte"}
ADDRESS_GENERIC = (
    "number house door flat plot unit suite apartment floor building near opposite post box po district the of "
    "de du des la le les and c o bis ter null shop office khasra survey ward block sector phase stage"
).split()

US_STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california",
    "co": "colorado", "ct": "connecticut", "de": "delaware", "fl": "florida", "ga": "georgia",
    "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas",
    "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland", "ma": "massachusetts",
    "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana",
    "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey", "nm": "new mexico",
    "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma",
    "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina",
    "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont",
    "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
    "dc": "district of columbia", "pr": "puerto rico",
}
INDIA_STATES = {
    "ap": ["andhra pradesh"], "ar": ["arunachal pradesh"], "as": ["assam"], "br": ["bihar"],
    "cg": ["chhattisgarh", "chattisgarh", "ct"], "ga": ["goa"], "gj": ["gujarat", "gujrat"],
    "hr": ["haryana"], "hp": ["himachal pradesh"], "jh": ["jharkhand"], "ka": ["karnataka"],
    "kl": ["kerala", "keralam"], "mp": ["madhya pradesh"], "mh": ["maharashtra", "maharastra"],
    "mn": ["manipur"], "ml": ["meghalaya"], "mz": ["mizoram"], "nl": ["nagaland"],
    "od": ["odisha", "orissa", "or"], "pb": ["punjab"], "rj": ["rajasthan"], "sk": ["sikkim"],
    "tn": ["tamil nadu", "tamilnadu"], "ts": ["telangana", "tg"], "tr": ["tripura"],
    "uk": ["uttarakhand", "uttaranchal", "ut"], "up": ["uttar pradesh"],
    "wb": ["west bengal", "paschim banga", "paschimbanga", "pashchim banga"],
    "dl": ["delhi", "new delhi", "nct of delhi"], "jk": ["jammu and kashmir", "jammu kashmir"],
    "ch": ["chandigarh"], "py": ["puducherry", "pondicherry"], "ld": ["lakshadweep"],
    "an": ["andaman and nicobar islands"], "la": ["ladakh"], "dn": ["dadra and nagar haveli"],
}
FRANCE_REGIONS = {
    "hdf": ["hauts de france", "aisne", "nord", "oise", "pas de calais", "somme"],
    "naq": ["nouvelle aquitaine", "charente", "charente maritime", "correze", "creuse", "dordogne",
            "gironde", "landes", "lot et garonne", "pyrenees atlantiques", "deux sevres", "vienne",
            "haute vienne"],
    "pdl": ["pays de la loire", "loire atlantique", "maine et loire", "mayenne", "sarthe", "vendee"],
    "idf": ["ile de france"], "ara": ["auvergne rhone alpes"], "bfc": ["bourgogne franche comte"],
    "bre": ["bretagne"], "cvl": ["centre val de loire"], "cor": ["corse"], "ges": ["grand est"],
    "nor": ["normandie"], "occ": ["occitanie"], "pac": ["provence alpes cote dazur", "paca"],
}

#: The phonetic key: replacements in this order, on one lower-case ASCII word.
SKELETON = (("ph", "f"), ("sh", "s"), ("ch", "k"), ("ck", "k"), ("[cq]", "k"), ("x", "ks"), ("z", "s"), ("w", "v"), ("j", "g"), ("d", "t"), ("m", "n"), ("[aeiouyh]", ""))
#: A name before a web ending, once points are spaces.
WEB = r"(?:https?\s*)?(?:www\s+)?([a-z0-9]+)\s+(?:com|net|org|in|co|fr|biz|info|us)\b"
#: What stands between two names of one business.
AKA = r"\b(?:aka|dba|d b a|a k a|also known as|doing business as|t a|trading as)\b"
#: Ways to write that there is no value.
NULLISH = r"(?i)<null>|\bnull\b|\bnan\b|\bn/?a\b"

"""Word lists and patterns that decide what a name says. FIXED VALUES unless marked as ours.

Names are matched in rule form (functions.text.rule_form) or accent-folded, as stated.
"""

#: (type, reason, where, pattern) in order, the first that holds decides. where: name, operator, both (name and operator), leaf.
ACCOMMODATION = [
    [("whole-home", "explicit_whole_unit_name", "name", r"\boyo\b.*\bhome\b|\b(entire (home|apartment|house)|whole home|holiday home|vacation rental|[1-9]\s*(br|bedroom|bed)\b.*apartment)\b")],
    [("whole-home", "furnished_rental_operator_blueground", "both", "blueground")],
    [("hostel", "hostel_category_or_name", "leaf", "^(hostel|youth_hostel)$"), ("hostel", "hostel_category_or_name", "name", r"\b(youth hostel|hostel|albergue|ostello|jeugdherberg)\b")],
    [("aparthotel", "explicit_aparthotel", "name", r"\b(aparthotel|apart hotel|apartment hotel|residence hoteliere|hotel apartments)\b"), ("aparthotel", "explicit_aparthotel", "leaf", "^aparthotel$")],
    [("serviced-apartment", "serviced_apartment_category_or_name", "leaf", "^(service_apartment|serviced_apartment)$"), ("serviced-apartment", "serviced_apartment_category_or_name", "name", r"\bserviced apartments?\b")],
    [("guesthouse-B&B", "guesthouse_category_or_name", "leaf", "^(bed_and_breakfast|guest_house)$"), ("guesthouse-B&B", "guesthouse_category_or_name", "name", r"\b(bed and breakfast|b and b|guesthouse|guest house|chambres d hotes)\b")],
    [("whole-home", "apartment_name_without_hotel_service_evidence", "name", r"\b(apartment|apartments|appartement|apartamento|appartamento|holiday homes)\b")],
    [("unknown", "mixed_operator_requires_property_evidence", "both", r"\b(sonder|domio)\b")],
    [("hotel", "overture_hotel_taxonomy_not_reception_verification", "leaf", "^(hotel|motel)$")],
]
#: a resort whose name says hotel; all else is unknown
RESORT_HOTEL = ("hotel", "resort_category_with_explicit_hotel_name")
UNKNOWN = ("unknown", "insufficient_or_ambiguous_accommodation_evidence")
ACCOMMODATION_LABELS = {
    "hotel": "Hotel", "aparthotel": "Aparthotel", "serviced-apartment": "Serviced apartment", "whole-home": "Whole home", "hostel": "Hostel", "guesthouse-B&B": "Guesthouse / B&B", "unknown": "Accommodation type unconfirmed",
}

#: Accent-folded names, any case.
LODGING = (
    r"\b(hotel|hotels|inn|suite|suites|resort|resorts|hostel|hostels|lodge|lodges|guest ?house|guesthouse|b\s*&\s*b|bed and breakfast|motel|villa|aparthotel|apart-hotel|serviced apartments?|residences?|accommodation|"
    r"chateau|ryokan|homestay|home stay|pension|auberge|casa rural)\b"
)
HOSPITALITY = (
    r"\b(marriott|hilton|hyatt|sheraton|westin|ascott|lebua|ritz-?carlton|four seasons|mandarin oriental|peninsula|shangri-?la|intercontinental|kempinski|raffles|aman|baiyoke|conrad|st\.? ?regis|waldorf astoria|fairmont|sofitel|"
    r"novotel|mercure|ibis|accor|centara|dusit|anantara|banyan tree|amari|avani|oberoi|taj|leela|rosewood|edition|bulgari|six senses|como|nobu|citizenm|yotel|premier inn|travelodge|holiday inn|crowne plaza|doubletree|"
    r"best western|radisson|wyndham|melia|nh hotels|barcelo|riu|iberostar|jumeirah|w hotels?|pullman|swissotel|park hyatt|grand hyatt|okura|nikko|prince (park|sakura|hotel)|ana intercontinental|cheval|bob w|blue orchid|native|"
    r"urbanest|oakwood|frasers hospitality|shama|somerset|citadines|staybridge|residence inn|homewood suites|extended stay|oyo|belvilla|occidental|atlantis the palm|autograph collection|airbnb|vrbo|booking\.com|park plaza)\b"
)
NOT_HOTEL_TERMS = [
    "consulting", "consultant", "consultants", "solutions", "solution", "trading", "chartered", "law", "llp", "plc", "ltd", "limited", "insurance", "embassy", "consulate", "chamber of commerce", "regional office", "head office",
    "corporation", "corp", "foundation", "school", "academy", "university", "hospital", "clinic", "dental", "government", "ministry", "council", "municipal", "logistics", "shipping", "freight", "import", "export", "accountant",
    "accountants", "accounting", "architect", "architects", "estate agents", "real estate agency", "surveyor", "surveyors", "recruitment", "staffing", "marketing agency", "advertising agency", "construction co",
    "construction company", "engineering co", "engineering company", "engineering services", "it services", "software", "warehouse", "depot", "centre for", "center for", "society", "association", "souq",
]
STREET = "(?:street|st|road|rd|square|sq|avenue|ave|lane|ln|way|drive|dr|boulevard|blvd|place|pl|court|ct|close|row|walk|circle|crescent|terrace)"
RISKY = r"\b(?:bank|church|mosque|temple)\b"
COMPOUND = r"by ?design\b"
#: Records whose own address contradicts their city.
MISPLACED = ["a89707ca-d74e-43f7-a6bb-4c9026608941", "c2e5184a-5962-4aad-83c1-71176704035a", "70797625-ea8d-431d-8ffd-378eb3851e74", "48900f9a-8968-49e7-bffa-46c93e62e59d"]

#: Ours: (reason, language, match, terms), terms in rule form. word: between word boundaries; substring: anywhere.
INSTITUTIONS = [
    ("school", "en", "word", ["school", "academy", "university", "college", "kindergarten"]),
    ("school", "fr", "word", ["ecole", "universite", "lycee"]),
    ("school", "es", "word", ["escuela", "universidad", "colegio"]),
    ("school", "de", "word", ["schule", "universitat", "gymnasium"]),
    ("school", "ja", "substring", ["学校", "大学", "幼稚園"]),
    ("school", "th", "substring", ["โรงเรียน", "มหาวิทยาลัย"]),
    ("hospital", "en", "word", ["hospital", "clinic", "medical centre", "medical center", "hospice"]),
    ("hospital", "fr", "word", ["hopital", "clinique"]),
    ("hospital", "ja", "substring", ["病院"]),
    ("government", "en", "word", ["embassy", "consulate", "ministry", "city hall", "court house"]),
    ("government", "fr", "word", ["ambassade", "mairie", "prefecture"]),
    ("care", "en", "word", ["nursing home", "care home", "homeless shelter", "orphanage"]),
]
QUARANTINED = ["h00000042"]
REVIEWED = ["university inn"]
#: Ours: (group, match, terms). full: the whole name; prefix terms may be followed by a property's own name.
BRANDS = [("selina", "word", ["selina"]), ("sonder", "word", ["sonder"]), ("blueground", "substring", ["blueground"]), ("kasa", "full", ["kasa"])]
#: Ours: a property word before the brand shows that the brand is only part of its own name.
PROPERTY_PREFIX = ["villa", "casa", "hotel"]

#: Versions of the rules above and of how names are shown; a change of either changes results.
ACCOMMODATION_VERSION, NAME_VERSION = "1.0.0", "1.1.0-tables"

"""Fixed word lists, unit names and patterns."""

# Words that carry no content (fixed values).
STOPWORDS = (
    "a an and are as at be been but by can could do does for from had has have how i if in into is it its me my of on or our per please should so such than that the their them then there these "
    "this those to under up upon us was we were what when where which while who whom why will with within would you your about above after again against all also any because before below between both "
    "during each few further here more most no nor not only other out over same some still very tell show give list explain according say says said current currently latest new old"
).split()

# Endings that the stemmer takes off, first match wins (fixed values).
SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "ed", "s")

# Spellings of units and the unit they stand for (fixed values).
UNIT_ALIASES = {
    "hour": "h", "hours": "h", "hr": "h", "hrs": "h", "minute": "min", "minutes": "min", "mins": "min", "second": "s", "seconds": "s", "sec": "s", "secs": "s",
    "day": "day", "days": "day", "week": "week", "weeks": "week", "unit": "units", "iu": "units", "units/kg/hr": "units/kg/h", "units/kg/hour": "units/kg/h",
    "unit/kg/h": "units/kg/h", "unit/kg": "units/kg", "units/hr": "units/h", "units/hour": "units/h", "ml/hr": "ml/h", "ml/hour": "ml/h", "pack": "packs", "dose": "doses", "time": "times",
}

# Units as they appear after a number, longest spellings first (fixed values).
UNITS = (
    r"units?/kg/h(?:r|our)?|units?/kg|units?/h(?:r|our)?|units?|iu|ml/kg/h(?:r)?|ml/kg|ml/h(?:r|our)?|ml|l/min|l|mg/kg/day|mg/kg|mg/h|mg|mcg/kg/min|mcg/kg|mcg|µg|g/l|g/dl|g|"
    r"mmol/l|mmol/h|mmol|meq/l|meq|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|%|mmhg|°c|kg|x ?10\^?9/l|packs?|doses?|times?|bags?|vials?|bottles?|beds?"
)

# Words too general to tell that two quantities describe one step (fixed values).
GENERIC_CONTEXT = (
    "sodium chloride glucose dextrose water saline units unit ml mls mmol seconds second minutes minute hours hour dose doses rate rates infusion infusions intravenous iv oral give given use used "
    "maximum minimum standard concentration table below above least more less than every each any all"
).split()

# Words about citations rather than content (fixed values).
CITATION_WORDS = (
    "per according states stated says document documents section clause protocol circular guideline conflict conflicts between however later earlier more recent newer older effective date dated "
    "amends amended amendment version current note see also both value values"
).split()

# Log scrubbing, in order (fixed values): pattern and what stands for a match.
SCRUB = (
    (r"(?<!\d)(?:\+?91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)", "<PHONE>"),
    (r"(?<!\d)\d{2}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)", "<ABHA>"),
    (r"(?<!\d)[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}(?!\d)", "<ID_NUMBER>"),
    (r"(?i)\b(?:UHID|MRN|IP\s?No\.?|CR\s?No\.?)\s*[:#-]?\s*[A-Z0-9/-]{4,20}", "<MRN>"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "<EMAIL>"),
)

# Abbreviations (fixed values): term, meaning, whether case counts.
ABBREVIATIONS = (
    ("aPTT", "activated partial thromboplastin time", False),
    ("ICU", "intensive care unit", True),
    ("IV", "intravenous", True),
    ("MRN", "medical record number", True),
    ("PRBC", "packed red blood cells", True),
    ("SOP", "standard operating procedure", True),
    ("TPN", "total parenteral nutrition", True),
)

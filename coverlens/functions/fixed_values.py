"""Fixed values that must equal the evaluated pipeline's for identical results.

These are data, stated plainly and in their original order.  Do not reorder:
unit removal is sequential, so order changes results.
"""

# --- fixed values: unit words removed from answers (in this order) -----------
UNIT_TEXTS = [
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile",
    "q .", "monkey", "prime", "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb",
    "tile", "per", "dm", "lt", "gain", "ab", "way", "west", "a .", "b .",
    "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change",
    "men", "soldier", "pie", "bc", "excess", "st", "inches", "noon", "percent", "by",
    "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq", "mark",
    "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women",
    "feet", "am", "pm", "hr", "cu cm", "square", "v â € ™", "are", "rupee", "rounds",
    "cubic", "cc", "mtr", "s", "ohm", "number", "kmph", "day", "hour", "minute",
    "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³",
    "hectare", "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g",
    "month", "km", "m", "cm", "mm", "apple", "liter", "loss", "yard", "pure",
    "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre",
    "meter", "inch",
]
# ------------------------------------------------------------------------------

# Rule: every unit also appears in plural form (unit + "s"), after all singulars.
UNIT_TEXTS_WITH_PLURALS = UNIT_TEXTS + [u + "s" for u in UNIT_TEXTS]

# --- fixed values: number words of a words-to-number reader ---------------------
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
    "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40,
    "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "hundred": 100, "thousand": 1000, "million": 1000000, "billion": 1000000000, "point": -1,
}
# ------------------------------------------------------------------------------

# --- fixed values: datasets answered by a choice letter ------------------------
CHOICE_DATASETS = ["mmlu_stem", "sat_math", "aqua", "gaokao2023"]
CHOICE_NARROW_DATASETS = ["sat_math", "aqua"]  # plus any name containing "mmlu"
SKIP_UNIT_DATASETS = ["carp_en", "minerva_math"]
# ------------------------------------------------------------------------------

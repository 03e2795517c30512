"""The theme prompts."""

#: Prompts in their order. Fixed values.
PROMPTS = (
    "a coastal landscape photograph",
    "a harbour or port scene with boats",
    "a countryside landscape photograph",
    "a woodland or forest scene",
    "a waterside or river scene",
    "a beach or shoreline photograph",
    "a village, town, or street scene photograph",
    "an old building or historic architecture photograph",
    "a dramatic sky photograph",
    "a sunset or sunrise photograph",
    "a misty or foggy landscape photograph",
    "a stormy weather photograph",
    "a moody atmospheric landscape photograph",
    "a photograph where light and weather create the mood",
    "a flower or plant close-up photograph",
    "a macro or texture detail photograph",
    "a garden photograph",
    "a tree or foliage photograph",
    "a bird or wildlife photograph",
    "a farm animal photograph",
    "a pet photograph",
    "a people or group photograph",
    "a portrait of one person",
    "an indoor scene photograph",
)

#: Prompts where a list of one's own is missing or empty, and a longer list of them. Fixed values.
DEFAULT_PROMPTS = (
    "a coastal landscape photograph",
    "a harbour or port scene with boats",
    "a countryside landscape photograph",
    "a woodland or forest scene",
    "a flower or plant close-up photograph",
    "a bird or wildlife photograph",
    "a farm animal photograph",
    "a pet photograph",
    "an old building or historic architecture photograph",
    "a village, town, or street scene photograph",
    "a travel photograph showing a place",
    "a dramatic sky photograph",
    "a sunset or sunrise photograph",
    "a misty or foggy landscape photograph",
    "a stormy weather photograph",
    "a moody atmospheric landscape photograph",
    "a photograph where light and weather create the mood",
    "a macro or texture detail photograph",
    "a waterside or river scene",
    "a beach or shoreline photograph",
    "a people or group photograph",
    "a portrait of one person",
    "a garden photograph",
    "a tree or foliage photograph",
    "a transport or vehicle photograph",
    "an indoor scene photograph",
    "an abstract visual pattern photograph",
)
DEFAULT_PROMPTS_LONG = (
    "a coastal landscape photograph",
    "a cliff-top coastal landscape photograph",
    "a beach with sea and shoreline photograph",
    "a harbour or port scene with boats",
    "boats in a harbour photograph",
    "boats on a river photograph",
    "a waterside or river scene",
    "a countryside landscape photograph",
    "a woodland or forest scene",
    "a mountain, hill, or valley landscape photograph",
    "a flower or plant close-up photograph",
    "a garden photograph",
    "a tree or foliage photograph",
    "a macro or texture detail photograph",
    "an abstract visual pattern photograph",
    "a bird or wildlife photograph",
    "wild animals in a natural setting photograph",
    "a farm animal photograph",
    "a herd of cows in a field photograph",
    "sheep grazing in a field photograph",
    "horses in a rural landscape photograph",
    "farm animals in pasture photograph",
    "a pet photograph",
    "a dog or cat photograph",
    "a people or group photograph",
    "a portrait of one person",
    "people walking in a town photograph",
    "people at an event photograph",
    "musicians or performers photograph",
    "workers or police officers photograph",
    "an old building or historic architecture photograph",
    "a village, town, or street scene photograph",
    "a travel photograph showing a place",
    "a city or urban street photograph",
    "a church or cathedral photograph",
    "a market or public square photograph",
    "a transport or vehicle photograph",
    "cars parked on a street photograph",
    "bicycles or cyclists photograph",
    "tents or camping equipment photograph",
    "an indoor scene photograph",
    "an indoor museum or gallery scene photograph",
    "a dramatic sky photograph",
    "a sunset or sunrise photograph",
    "a misty or foggy landscape photograph",
    "a stormy weather photograph",
    "a moody atmospheric landscape photograph",
    "a photograph where light and weather create the mood",
    "a snow or winter landscape photograph",
    "a night street photograph",
    "a summer countryside photograph",
)
#: Search terms where none are given. Fixed values.
DEFAULT_TERMS = ("cars", "bicycles", "men", "women", "children", "dogs", "cats", "tents", "boats", "birds", "cows", "horses", "night", "winter", "summer")

"""Word lists for phrase mining. Any other lists can be given instead."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Lexicon:
    """triggers: what comes before a name, each with one space after it. parts: what a name may contain. stops: words no name has.
    known: names that need no part. praise: words that follow a name and a form of to be."""

    triggers: tuple[str, ...]
    parts: tuple[str, ...]
    stops: tuple[str, ...]
    known: tuple[str, ...] = ()
    praise: tuple[str, ...] = ()


#: Results on restaurant reviews follow from these lists.
FOOD = Lexicon(
    triggers=(
        "try the ", "tried the ", "had the ", "get the ", "ordered the ", "order the ", "love the ", "loved the ", "loved their ", "enjoy the ",
        "enjoyed the ", "recommend the ", "recommended the ", "try their ", "get their ", "got the ", "grab the ",
    ),
    parts=(
        "burger", "burgers", "sandwich", "sandwiches", "salad", "salads", "soup", "soups", "steak", "steaks", "pasta", "pizza", "pizzas", "wings", "taco",
        "tacos", "burrito", "burritos", "bowl", "bowls", "roll", "rolls", "sushi", "ramen", "pho", "curry", "rice", "cake", "pie", "tart", "tarts", "donut",
        "donuts", "croissant", "croissants", "bun", "buns", "bread", "toast", "waffle", "waffles", "pancake", "pancakes", "omelette", "eggs benedict",
        "bacon", "fries", "hash browns", "hash", "latte", "coffee", "cocktail", "margarita", "beer", "wine", "whiskey", "bourbon", "martini", "platter",
        "wrap", "quesadilla", "nachos", "guacamole", "flatbread", "meatball", "meatballs", "ribs", "brisket", "pulled pork", "cheesesteak", "reuben", "gyro",
        "falafel", "shawarma", "dumplings", "noodles", "fried rice", "lo mein", "pad thai", "tikka masala", "biryani", "naan", "samosa", "crab cake",
        "oyster", "oysters", "scallop", "scallops", "mac and cheese", "grilled cheese", "hot dog", "pretzel", "cheesecake", "brownie", "ice cream", "gelato",
        "muffin", "scone", "danish", "mousse", "tiramisu", "benedict", "scramble", "omelet", "skillet", "cheeseburger", "chicken fried", "country fried",
    ),
    stops=(
        "prices", "price", "service", "staff", "atmosphere", "ambiance", "experience", "visit", "location", "parking", "wait", "line", "reasonable",
        "amazing", "awesome", "great", "good", "bad", "everything", "nothing", "something", "anyone", "everyone", "definitely", "highly", "always", "never",
        "usually", "little", "small", "large", "big", "huge", "tiny", "restaurant", "place", "spot", "cafe", "bar", "menu", "portion", "portions", "value",
        "money", "worth", "which", "that", "who", "where", "when", "while", "although", "though", "with", "without", "from", "into", "onto", "upon", "about",
        "after", "and", "but", "or", "so", "yet", "for", "nor", "was", "were", "is", "are", "has", "have", "had", "been", "not", "just", "even", "also",
        "too", "very", "really", "quite", "here", "there", "this", "these", "those", "my", "our", "your", "their", "its", "his", "her", "we", "they", "you",
        "it", "he", "she", "off", "out", "up", "down", "over", "back", "to", "a", "an", "the", "of", "in", "on", "at", "by", "as", "if", "do", "did", "get",
        "got", "try", "go", "went",
    ),
    known=(
        "eggs benedict", "french toast", "chicken fried steak", "biscuits and gravy", "fish and chips", "mac and cheese", "pad thai", "fried chicken",
        "prime rib", "new york strip", "ribeye", "filet mignon", "creme brulee", "chocolate lava cake", "bananas foster", "club sandwich", "blt", "reuben",
        "philly cheesesteak", "morning bun", "sticky bun", "cinnamon roll",
    ),
    praise=(
        "amazing", "delicious", "incredible", "fantastic", "perfect", "excellent", "outstanding", "phenomenal",
    ),
)

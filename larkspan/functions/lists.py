"""Cue lists and patterns of the screening cascade."""

# These lists and patterns decide which reviews are rejected.
ORIGINS = """
indian indians pakistani bangladeshi sri-lankan nepali nepalese bhutanese afghan
british english irish scottish welsh american americans canadian australian european
chinese japanese korean thai vietnamese filipino asian asians mexican cuban
puerto-rican hispanic latino latina latinx italian french german greek spanish
russian polish african african-american caucasian arab arabic middle-eastern
persian turkish israeli jewish muslim muslims islamic hindu hindus christian
christians catholic sikh buddhist halal kosher desi brahmin dalit caste
immigrant immigrants foreigner foreigners accent minority minorities racist
racism sexist sexism gay lesbian transgender
""".split()
PLACES = """
india pakistan bangladesh china japan korea mexico canada england scotland
uk united-kingdom united-states usa america london paris delhi mumbai bangalore
bengaluru chennai hyderabad kolkata dubai singapore toronto
alabama alaska arizona arkansas california colorado connecticut delaware florida
georgia hawaii idaho illinois indiana iowa kansas kentucky louisiana maine
maryland massachusetts michigan minnesota mississippi missouri montana nebraska
nevada new-hampshire new-jersey new-mexico new-york north-carolina north-dakota
ohio oklahoma oregon pennsylvania rhode-island south-carolina south-dakota
tennessee texas utah vermont virginia washington west-virginia wisconsin wyoming
philadelphia philly tampa indianapolis nashville new-orleans nola tucson reno
santa-barbara saint-louis st.-louis boise edmonton sparks las-vegas phoenix
""".split()
ORIGIN_TERMS = ORIGINS + PLACES
GENDER_CUES = [
    r"\b(?:my|our)\s+(?:husband|wife|boyfriend|girlfriend|hubby|hubs|wifey|fianc[eé]e?|mom|mother|mum|dad|father|son|daughter|brother|sister|grandma|grandmother|grandpa|grandfather)\b",
    r"\bas\s+an?\s+(?:man|woman|guy|girl|lady|gentleman|mother|father|mom|dad|husband|wife|female|male)\b",
    r"\bi\s*(?:am|'m|’m)\s+an?\s+(?:man|woman|guy|girl|lady|mother|father|mom|dad|female|male)\b",
    r"\b(?:ma'am|ma’am|sir|mrs|mr|ms)\b",
]
#: Title-case words that a lexicon takes for names: allowed anywhere, and only as the first word of a sentence.
ALLOWED = "Am Are Be Can Do Done Even Go He Her Here His Me Mine My So The You Ok Okay Beer Tea Night".split()
ALLOWED_FIRST = """
Love Just Price Fine Long Tiny Will May Hope Ah Con Deep Edit Five Free Hey Hi Ideal Line
Oh One Soon Thin Way Lot Made Take Said Than Tell Job Side Run Per Young Ago Win Else Due Age Red Chance Won Save Key
Door Floor Carry Sad Brand Bet Till Lucky Core Sky Rain Solo Hang Kinda Mile Diet Lane Mate Hat Fee Tie
Tone Rush Odd Sake Pace Vital Ate Bang Dare Jet Mall Tale Skip Flip Loyal Harsh Lean Haven Miracle Fair Kick
Beat Rock Ice
""".split()
STOP_WORDS = """
the a an and or but if of to in on at for with is are was were be been it its this
that these those i my me we our you your they them their he she his her not no so
as by from have has had do did does very
""".split()
URL_CONTACT = r"(https?://|www\.|\b[\w.+-]+@[\w-]+\.[\w.]+|\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b)"
ROLE_NAME = r"\b(?:server|waiter|waitress|manager|owner|host|hostess|bartender|cashier|agent|rep|representative|seller|technician|driver|stylist|dentist|doctor|dr\.?)\s+(?:named\s+)?[A-Z][a-z]{2,}"

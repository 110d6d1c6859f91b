"""Word lists of forms."""

#: Words of which the labels of forms are made.
LABEL_WORDS = (
    "given name names first last family surname middle other date of birth dob number phone mobile home work business "
    "address residential postal mailing email title suffix initials in full yes no male female mr mrs miss ms dr prof "
    "country occupation signature day month year dd mm yyyy preferred previous former tax file tfn contact and or the a "
    "employer employee started working for you gender sex marital status suburb state postcode town locality street "
    "unit apartment licence license passport medicare card expiry issue place age relationship "
    "withheld income amount total gross net description payer code type rate balance limit franked unfranked credit"
).split()
#: Words of sentences to the person who fills in a form.
INSTRUCTION_WORDS = "you your we our please must should will may if provide attach complete applicant applicants form section instructions required refer tick enter write".split()
#: Words that sentences have and values don't.
STOP_WORDS = (
    "the you your must provide if or of to and is are will with for that this may be by in on as at an a we our not from "
    "have has which should please"
).split()
#: Labels of one word.
SINGLE_LABELS = "number address name email phone mobile date title suffix country details signature".split()
#: Words of which an address has one.
STREET_WORDS = (
    "street st road rd avenue ave av drive dr court ct place pl lane ln crescent cres cr highway hwy parade pde boulevard blvd "
    "terrace tce way close circuit cct square sq esplanade esp grove rise row walk track trail mews view ridge glen loop path unit lot apartment apt level"
).split()
#: The same in several words.
STREET_PHRASES = ("po box", "gpo box", "locked bag")

"""The rules written out once more, for the SQL that queries are compared with: an error in the library's own lists then
shows as a difference."""

# Fixed values.
NAME_PATTERNS = [
    ('email', '(^|_)(email|e_mail|mail_address|e_?mail_?address)(_|$)'),
    ('phone', '(^|_)(phone|telephone|mobile|cell_?(phone|number|no)|phone_number)(_|$)'),
    ('birthdate', '(^|_)(birth_?date|birth_?day|dob|date_of_birth)(_|$)'),
    ('address2', '(^|_)(address_?(line_?)?2|addr_?2|apartment|suite)(_|$)'),
    ('address', '(^|_)(address|addr|street)(_|$)'),
    ('city', '(^|_)(city|town)(_|$)'),
    ('state', '(^|_)(state|province)(_|$)'),
    ('postal', '(^|_)(zip|zip_?code|postal|postal_?code|postcode)(_|$)'),
    ('country', '(^|_)(country)(_|$)'),
    ('full-name', '(^|_)(full_?name|customer_name|contact_name)(_|$)'),
    ('given-name', '(^|_)(first_?name|given_?name|fname)(_|$)'),
    ('surname', '(^|_)(last_?name|surname|family_?name|lname)(_|$)'),
    ('generational-suffix', '(^|_)(suffix)(_|$)'),
    ('title', '(^|_)(title|salutation|name_prefix)(_|$)'),
    ('gender', '(^|_)(gender|sex)(_|$)'),
    ('create-dt', '(^|_)((created|creation|signup|registered)_?(at|on|dt|date|ts|time))(_|$)'),
    ('update-dt', '(^|_)((updated|modified|changed)_?(at|on|dt|date|ts|time))(_|$)'),
    ('pk', '(^|_)(uuid|guid|id|pk)(_|$)'),
]
UUID_PATTERN = '(^|_)(uuid|guid)(_|$)'
VALUE_PATTERNS = {
    'email': r'[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}',
    'ipv4': r'[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}',
    'card': r'[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}',
    'date': r'[0-9]{4}-[0-9]{2}-[0-9]{2}',
    'phone': r'(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}',
}
SEMANTICS = [
    'pk', 'address', 'address2', 'birthdate', 'city', 'country', 'state', 'postal', 'create-dt', 'update-dt', 'email', 'full-name', 'given-name', 'surname', 'title', 'generational-suffix', 'gender', 'phone',
]
NUMERIC_TYPES = ['LONG', 'BIGINT', 'INT', 'INTEGER', 'SMALLINT', 'TINYINT', 'DOUBLE', 'FLOAT', 'DECIMAL', 'NUMERIC', 'NUMBER']
UNSUPPORTED_TYPES = ['INTERVAL', 'VOID', 'ARRAY', 'MAP', 'STRUCT', 'VARIANT', 'OBJECT', 'GEOGRAPHY', 'GEOMETRY']
MATCH_RULES = [
    ('email',),
    ('phone',),
    ('address', 'birthdate'),
    ('address', 'given_name', 'surname'),
    ('birthdate', 'given_name', 'surname'),
]
MATCH_WEIGHTS = {'email': 2.0, 'phone': 2.0, 'address': 1.0, 'birthdate': 1.0, 'given_name': 0.5, 'surname': 0.5}
# One field that is alike, others that are equal.
SIMILAR_RULES = [
    ('email', ('address',)),
    ('email', ('birthdate',)),
    ('email', ('given_name', 'surname')),
    ('address', ('birthdate', 'given_name')),
    ('address', ('birthdate', 'surname')),
    ('given_name', ('address', 'surname')),
    ('given_name', ('birthdate', 'surname')),
    ('surname', ('address', 'given_name')),
    ('surname', ('birthdate', 'given_name')),
]
SIMILAR_WEIGHTS = {'email': 1.0, 'address': 0.5, 'given_name': 0.5, 'surname': 0.5}
SIMILAR_LENGTH = 4

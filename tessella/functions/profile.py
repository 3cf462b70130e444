"""An institution's profile: its hosts, acronyms and department names, as data.

``EXAMPLE`` is a profile of a research institution; pass another one where a function takes a profile.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: Acronyms in the order in which they are replaced, and what they stand for.
ACRONYMS = (
    ("biochem", "department of biochemistry"), ("caf", "central animal facility"), ("ces", "centre for ecological sciences"),
    ("cidr", "centre for infectious disease research"), ("cns", "centre for neuroscience"), ("mcb", "department of microbiology and cell biology"),
    ("mbu", "molecular biophysics unit"), ("dbg", "department of developmental biology and genetics"), ("ipc", "department of inorganic and physical chemistry"),
    ("mrc", "materials research centre"), ("orgchem", "department of organic chemistry"), ("sscu", "solid state and structural chemistry unit"),
    ("csa", "computer science and automation"), ("ece", "electrical communication engineering"), ("dese", "department of electronic systems engineering"),
    ("ee", "electrical engineering"), ("cistup", "centre for infrastructure, sustainable transportation and urban planning"), ("be", "bioengineering"),
    ("csp", "centre for sustainable technologies"), ("cense", "centre for nanoscience and engineering"), ("cds", "computational and data sciences"),
    ("mgmt", "management studies"), ("icer", "interdisciplinary centre for energy research"), ("icwar", "interdisciplinary centre for water research"),
    ("cps", "centre for contemporary studies"), ("msci", "department of materials science"), ("serc", "supercomputer education and research centre"),
    ("iqti", "international centre for quantum technology initiatives"), ("abcmc", "atomic, biomolecular and chemical sciences centre"),
    ("longevity", "centre for longevity research"), ("aero", "aerospace engineering"), ("caos", "centre for atmospheric and oceanic sciences"),
    ("ceas", "centre for earth sciences"), ("camm", "centre for advanced manufacturing and materials"), ("dm", "department of mathematics"),
    ("cst", "centre for scientific teaching"), ("chemeng", "chemical engineering"), ("civil", "civil engineering"), ("dccc", "digital campus and cloud computing centre"),
    ("materials", "materials engineering"), ("mecheng", "mechanical engineering"), ("physics_jap", "department of physics (japan group page)"),
    ("cct", "centre for catalysis and transition metal chemistry"), ("chep", "centre for high energy physics"), ("math", "mathematics department"),
    ("iap", "instrumentation and applied physics"), ("physics", "department of physics"), ("cbr", "centre for brain research"),
    ("fsid", "foundation for science, innovation and development"), ("diarcoe", "department of interdisciplinary and applied research in chemical engineering"),
)
#: Departments with all their names.
DEPARTMENTS = {
    "biochem": ("department of biochemistry", "biochemistry department", "biochemistry"),
    "caf": ("central animal facility",),
    "ces": ("centre for ecological sciences", "ecological sciences centre", "ecological sciences"),
    "cidr": ("centre for infectious disease research", "infectious disease research centre"),
    "cns": ("centre for neuroscience", "neuroscience centre", "neuroscience"),
    "mcb": ("department of microbiology and cell biology", "microbiology and cell biology"),
    "mbu": ("molecular biophysics unit", "molecular biophysics"),
    "dbg": ("department of developmental biology and genetics", "developmental biology and genetics"),
    "ipc": ("department of inorganic and physical chemistry", "inorganic and physical chemistry"),
    "mrc": ("materials research centre", "materials research"),
    "orgchem": ("department of organic chemistry", "organic chemistry department"),
    "sscu": ("solid state and structural chemistry unit", "solid state chemistry"),
    "csa": ("computer science and automation", "csa department"),
    "ece": ("electrical communication engineering", "ece department"),
    "dese": ("department of electronic systems engineering", "electronic systems engineering"),
    "ee": ("electrical engineering", "electrical engineering department"),
    "cistup": ("centre for infrastructure, sustainable transportation and urban planning",),
    "be": ("bioengineering", "bioengineering department"),
    "csp": ("centre for sustainable technologies", "sustainable technologies centre"),
    "cense": ("centre for nanoscience and engineering", "nanoscience and engineering"),
    "cds": ("computational and data sciences", "computational data sciences", "cds department"),
    "mgmt": ("management studies", "management department"),
    "icer": ("interdisciplinary centre for energy research", "energy research centre"),
    "icwar": ("interdisciplinary centre for water research", "water research centre"),
    "cps": ("centre for contemporary studies", "contemporary studies centre"),
    "msci": ("department of materials science", "materials science department"),
    "serc": ("supercomputer education and research centre", "supercomputer research centre"),
    "iqti": ("international centre for quantum technology initiatives",),
    "abcmc": ("atomic, biomolecular and chemical sciences centre",),
    "longevity": ("centre for longevity research", "longevity research centre"),
    "aero": ("aerospace engineering", "aerospace engineering department"),
    "caos": ("centre for atmospheric and oceanic sciences", "atmospheric and oceanic sciences"),
    "ceas": ("centre for earth sciences", "earth sciences centre"),
    "camm": ("centre for advanced manufacturing and materials",),
    "dm": ("department of mathematics", "mathematics department", "mathematics"),
    "cst": ("centre for scientific teaching", "scientific teaching centre"),
    "chemeng": ("chemical engineering", "chemical engineering department"),
    "civil": ("civil engineering", "civil engineering department"),
    "dccc": ("digital campus and cloud computing centre", "cloud computing centre"),
    "materials": ("materials engineering", "materials engineering department"),
    "mecheng": ("mechanical engineering", "mechanical engineering department"),
    "math": ("mathematics department", "mathematics"),
    "iap": ("instrumentation and applied physics", "applied physics"),
    "physics": ("department of physics", "physics department", "physics"),
    "cbr": ("centre for brain research", "brain research centre"),
}


@dataclass(frozen=True)
class Profile:
    primary_host: str = "example.com"
    academic_hosts: tuple[str, ...] = (".edu", ".ac.")
    external_hosts: tuple[str, ...] = (".edu/", ".ac.uk")
    acronyms: tuple[tuple[str, str], ...] = ACRONYMS
    departments: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(DEPARTMENTS))


EXAMPLE = Profile()

"""Per-residue constants. All are fixed values: published numbers that results depend on."""

#: Average molecular weights of the free amino acids.
WEIGHTS = {
    "A": 89.093, "C": 121.158, "D": 133.103, "E": 147.129, "F": 165.189, "G": 75.067, "H": 155.155, "I": 131.173, "K": 146.188, "L": 131.173,
    "M": 149.211, "N": 132.118, "P": 115.131, "Q": 146.145, "R": 174.20, "S": 105.093, "T": 119.119, "V": 117.146, "W": 204.225, "Y": 181.189,
}
#: Transfer energies between cyclohexane and water.
ENERGIES = {
    "A": -1.81, "C": -1.28, "D": 8.72, "E": 6.81, "F": -2.98, "G": -0.94, "H": 4.66, "I": -4.92, "K": 5.55, "L": -4.92,
    "M": -2.35, "N": 6.64, "P": 0.0, "Q": 5.54, "R": 14.92, "S": 3.40, "T": 2.57, "V": -4.04, "W": -2.33, "Y": 0.14,
}
#: pK values of the groups that take up and give off a proton.
POSITIVE_PK = {"Nterm": 9.38, "K": 10.67, "R": 12.10, "H": 6.04}
NEGATIVE_PK = {"Cterm": 2.15, "D": 3.71, "E": 4.15, "C": 8.14, "Y": 10.10}
AMIDE_CTERM_PK = 15.0
#: Consensus hydrophobicity scale of Eisenberg.
EISENBERG = {
    "A": 0.62, "C": 0.29, "D": -0.9, "E": -0.74, "F": 1.2, "G": 0.48, "H": -0.4, "I": 1.4, "K": -1.5, "L": 1.1,
    "M": 0.64, "N": -0.78, "P": 0.12, "Q": -0.85, "R": -2.5, "S": -0.18, "T": -0.05, "V": 1.1, "W": 0.81, "Y": 0.26,
}
#: Three groups of residues for each property.
PROPERTY_GROUPS = {
    "hydrophobicity_PRAM900101": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "hydrophobicity_ARGP820101": ("QSTNGDE", "RAHCKMV", "LYPFIW"),
    "hydrophobicity_ZIMJ680101": ("QNGSWTDERA", "HMCKV", "LPFYI"),
    "hydrophobicity_PONP930101": ("KPDESNQT", "GRHA", "YMFWLCVI"),
    "hydrophobicity_CASG920101": ("KDEQPSRNTG", "AHYMLV", "FIWC"),
    "hydrophobicity_ENGD860101": ("RDKENQHYP", "SGTAW", "CVLIMF"),
    "hydrophobicity_FASG890101": ("KERSQD", "NTPG", "AYHWVMFLIC"),
    "normwaalsvolume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "secondarystruct": ("EALMQKRH", "VIYCWFT", "GNPSD"),
    "solventaccess": ("ALFCGIVW", "RKQEND", "MSPTHY"),
}
#: Numbers that stand for nucleotides.
NUCLEOTIDE_MAPS = {
    "integer": {"T": 0.0, "C": 1.0, "A": 2.0, "G": 3.0},
    "real": {"T": 1.5, "C": 0.5, "A": -1.5, "G": -0.5},
    "eiip": {"T": 0.1335, "C": 0.1340, "A": 0.1260, "G": 0.0806},
    "atomic": {"T": 66.0, "C": 58.0, "A": 70.0, "G": 78.0},
}
#: Twist, tilt, roll, shift, slide and rise of each dinucleotide.
DINUCLEOTIDES = {
    "AA": (0.06, 0.5, 0.27, 1.59, 0.11, -0.11), "AC": (1.50, 0.50, 0.80, 0.13, 1.29, 1.04), "AG": (0.78, 0.36, 0.09, 0.68, -0.24, -0.62), "AT": (1.07, 0.22, 0.62, -1.02, 2.51, 1.17),
    "CA": (-1.38, -1.36, -0.27, -0.86, -0.62, -1.25), "CC": (0.06, 1.08, 0.09, 0.56, -0.82, 0.24), "CG": (-1.66, -1.22, -0.44, -0.82, -0.29, -1.39), "CT": (0.78, 0.36, 0.09, 0.68, -0.24, -0.62),
    "GA": (-0.08, 0.5, 0.27, 0.13, -0.39, 0.71), "GC": (-0.08, 0.22, 1.33, -0.35, 0.65, 1.59), "GG": (0.06, 1.08, 0.09, 0.56, -0.82, 0.24), "GT": (1.50, 0.50, 0.80, 0.13, 1.29, 1.04),
    "TA": (-1.23, -2.37, -0.44, -2.24, -1.51, -1.39), "TC": (-0.08, 0.5, 0.27, 0.13, -0.39, 0.71), "TG": (-1.38, -1.36, -0.27, -0.86, -0.62, -1.25), "TT": (0.06, 0.5, 0.27, 1.59, 0.11, -0.11),
}
#: Atoms (C, H, N, O, S) of the free amino acids.
FORMULAS = {
    "A": (3, 7, 1, 2, 0), "C": (3, 7, 1, 2, 1), "D": (4, 7, 1, 4, 0), "E": (5, 9, 1, 4, 0), "F": (9, 11, 1, 2, 0), "G": (2, 5, 1, 2, 0), "H": (6, 9, 3, 2, 0), "I": (6, 13, 1, 2, 0), "K": (6, 14, 2, 2, 0), "L": (6, 13, 1, 2, 0),
    "M": (5, 11, 1, 2, 1), "N": (4, 8, 2, 3, 0), "P": (5, 9, 1, 2, 0), "Q": (5, 10, 2, 3, 0), "R": (6, 14, 4, 2, 0), "S": (3, 7, 1, 3, 0), "T": (4, 9, 1, 3, 0), "V": (5, 11, 1, 2, 0), "W": (11, 12, 2, 2, 0), "Y": (9, 11, 1, 3, 0),
}
#: Coding preference of bases: how unevenly a base is spread over the three codon places, and its share. Each base has the
#: probabilities for the steps from the largest down, and a weight.
CODING_POSITION = {
    "steps": [1.9, 1.8, 1.7, 1.6, 1.5, 1.4, 1.3, 1.2, 1.1, 0.0],
    "table": {
        "A": ((0.94, 0.68, 0.84, 0.93, 0.58, 0.68, 0.45, 0.34, 0.20, 0.22), 0.26),
        "C": ((0.80, 0.70, 0.70, 0.81, 0.66, 0.48, 0.51, 0.33, 0.30, 0.23), 0.18),
        "G": ((0.90, 0.88, 0.74, 0.64, 0.53, 0.48, 0.27, 0.16, 0.08, 0.08), 0.31),
        "T": ((0.97, 0.97, 0.91, 0.68, 0.69, 0.44, 0.54, 0.20, 0.09, 0.09), 0.33),
    },
}
CODING_CONTENT = {
    "steps": [0.33, 0.31, 0.29, 0.27, 0.25, 0.23, 0.21, 0.17, 0.0],
    "table": {
        "A": ((0.28, 0.49, 0.44, 0.55, 0.62, 0.49, 0.67, 0.65, 0.81), 0.11),
        "C": ((0.82, 0.64, 0.51, 0.64, 0.59, 0.59, 0.43, 0.44, 0.39), 0.12),
        "G": ((0.40, 0.54, 0.47, 0.64, 0.64, 0.73, 0.41, 0.41, 0.33), 0.15),
        "T": ((0.28, 0.24, 0.39, 0.40, 0.55, 0.75, 0.56, 0.69, 0.51), 0.14),
    },
}
#: Hydrophobicity, hydrophilicity and side-chain mass of each residue.
SIDE_CHAINS = {
    "A": (0.62, -0.5, 15.0), "C": (0.29, -1.0, 47.0), "D": (-0.90, 3.0, 59.0), "E": (-0.74, 3.0, 73.0), "F": (1.19, -2.5, 91.0), "G": (0.48, 0.0, 1.0), "H": (-0.40, -0.5, 82.0), "I": (1.38, -1.8, 57.0), "K": (-1.50, 3.0, 73.0), "L": (1.06, -1.8, 57.0),
    "M": (0.64, -1.3, 75.0), "N": (-0.78, 0.2, 58.0), "P": (0.12, 0.0, 42.0), "Q": (-0.85, 0.2, 72.0), "R": (-2.53, 3.0, 101.0), "S": (-0.18, 0.3, 31.0), "T": (-0.05, -0.4, 45.0), "V": (1.08, -1.5, 43.0), "W": (0.81, -3.4, 130.0), "Y": (0.26, -2.3, 107.0),
}


def standardised(table: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...]]:
    """Each property less its mean over the residues, by its population deviation."""
    columns = []
    for values in zip(*table.values(), strict=True):
        mean = sum(values) / len(values)
        deviation = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
        columns.append([(v - mean) / deviation for v in values])
    return dict(zip(table, zip(*columns, strict=True), strict=True))

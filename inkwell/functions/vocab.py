"""Word lists, journals and tiers, and what is derived from them."""

from __future__ import annotations

# The lists of this block are stated as they must be for equal results.
KEYWORDS_V1 = [
    "microbiome", "gut microbiota", "metagenomics", "microbiome bioinformatics", "shotgun metagenomics",
    "functional metagenomics", "metagenomic sequencing", "gene", "genes", "gene expression", "transcriptomics",
    "metatranscriptomics", "functional genes", "gene regulation", "gene ontology", "kegg", "host gene expression",
    "microbiome-gene interactions", "gene pathways", "metabolite", "metabolites", "metabolism", "metabolomics",
    "metabolic pathway", "metabolic network", "metabolomic profiling", "metabolite production",
    "short-chain fatty acids", "scfa", "butyrate", "acetate", "propionate", "metabolic reconstruction",
    "metabolic modeling", "microbiome-metabolome", "microbial metabolism", "metabolic capacity", "mimosa", "mimosa2",
    "bacteria", "bacterial", "microbiota", "microbial", "microbial community", "microbial species", "gut flora",
    "gut bacteria", "16s rna", "16s rrna", "taxonomy", "firmicutes", "bacteroidetes", "proteobacteria",
    "actinobacteria", "escherichia", "bifidobacterium", "lactobacillus", "akkermansia", "prevotella",
]
KEYWORDS_1 = [
    "microbiome", "gut microbiota", "metagenomics", "microbiome bioinformatics", "shotgun metagenomics",
    "functional metagenomics", "metagenomic sequencing", "gene", "genes", "gene expression", "transcriptomics",
    "metatranscriptomics", "functional genes", "gene regulation", "gene pathways", "gene networks", "gene ontology",
    "go enrichment", "go term", "go terms", "go analysis", "metabolite", "metabolites", "metabolism", "metabolomics",
    "metabolic pathway", "metabolic network", "metabolomic profiling", "metabolite production",
    "short-chain fatty acids", "scfa", "butyrate", "acetate", "propionate", "metabolic reconstruction",
    "metabolic modeling", "microbiome-metabolome", "microbial metabolism", "metabolic capacity", "mimosa", "mimosa2",
    "bacteria", "bacterial", "microbiota", "microbial", "microbial community", "microbial species", "taxa",
    "taxonomy", "otu", "otus", "amplicon", "16s", "16s rrna", "16s sequencing", "host gene expression",
    "host transcriptomics", "host response", "host-microbiome", "host-microbiota", "host genetics",
    "tryptophan metabolism", "bile acid metabolism", "bile acids", "immune pathways", "immune gene", "immune genes",
    "immune response", "t cell", "t cells", "t-cell", "t-cells", "b cell", "b cells", "b-cell", "b-cells",
    "functional profiling", "functional annotation", "pathway enrichment", "gene set enrichment", "gsea",
    "metagenome-scale", "genome-scale metabolic model", "gsmm", "constraint-based modeling",
]
KEYWORDS_2_MORE = [
    "prokaryote", "prokaryotes", "prokaryotic", "archaea", "archaeome", "microbial ecology", "microbial dysbiosis",
    "dysbiosis", "microbial interactions", "microbe-microbe interactions", "microbial diversity", "alpha diversity",
    "beta diversity", "microbial networks", "multi-omics", "immune–microbiome interaction", "microbiome–immune axis",
    "gut–brain axis", "gut–liver axis", "gut–lung axis", "fecal microbiota transplantation", "fmt", "probiotics",
    "prebiotics", "synbiotics", "postbiotics", "qiime2", "dada2", "asv", "asvs", "humann", "metaphlan",
    "metabolite quantification", "tryptamine", "kynurenine pathway", "secondary bile acids",
    "branched-chain fatty acids", "amino acid metabolism", "trimethylamine", "tma", "tmao",
]
SKIPPED_SECTIONS_V1 = [
    "acknowledgements", "acknowledgments", "funding", "author contributions", "authors contributions",
    "authors’ contributions", "authors' contributions", "data availability", "availability of data",
    "supplementary material", "supplementary materials", "competing interests", "conflict of interest",
    "publishers note", "publisher's note", "publisher’s note", "references",
]
SKIPPED_SECTIONS_V2 = [
    "acknowledgements", "acknowledgments", "funding", "author contributions", "author contribution",
    "competing interests", "conflict of interest", "conflicts of interest", "ethics", "ethical approval",
    "data availability", "availability of data", "additional information", "supplementary material",
    "supplementary materials", "supplementary information", "extended data", "publisher's note", "publisher note",
    "references", "abbreviations",
]
PILOT_TIERS = {
    1: ["Microbiome", "Gut", "The ISME Journal", "Nature Microbiology", "Cell Host & Microbe", "Cell Systems", "mSystems", "Environmental Microbiology", "Environmental Microbiology Reports", "Applied and Environmental Microbiology", "BMC Microbiology"],
    2: ["BMC Bioinformatics", "Bioinformatics", "PLOS Computational Biology", "PLoS Computational Biology", "Nature Medicine", "Nature Biotechnology", "Nature Methods"],
    3: ["Nature", "Nature Communications", "Science", "Cell", "Proc Natl Acad Sci U S A", "PNAS"],
}
JOURNALS = [
    "Microbiome", "Gut", "The ISME Journal", "Nature Microbiology", "Cell Host & Microbe", "Cell Systems", "mSystems",
    "Environmental Microbiology", "Environmental Microbiology Reports", "Applied and Environmental Microbiology",
    "BMC Microbiology", "BMC Bioinformatics", "Bioinformatics", "PLOS Computational Biology", "Nature Communications",
    "Nature Medicine", "Nature Biotechnology", "Nature Methods", "Nature", "Science", "Cell", "Proc Natl Acad Sci U S A",
]
#: Names of one field, the first that holds a value counts.
CHAINS = {
    "pilot": {
        "pmcid": ["pmcid", "PMCID", "pmcid_upper", "pmcid_lower"],
        "title": ["title", "article_title", "full_title", "title_full"],
        "journal": ["journal", "journal_title", "journalTitle", "journal_name", "source"],
        "abstract": ["abstractText", "abstract", "abstract_text"],
        "year": ["year", "pubYear", "publication_year", "pub_year"],
    },
    "full": {
        "pmcid": ["pmcid", "PMCID", "id"],
        "title": ["title", "article_title"],
        "journal": ["journal", "journalTitle", "source"],
        "abstract": ["abstract", "abstractText"],
        "year": ["year", "pubYear", "publicationYear", "firstPublicationDate", "pubDate", "date"],
    },
}
# End of the fixed values.

KEYWORDS_2 = KEYWORDS_1 + KEYWORDS_2_MORE
KEYWORD_SETS = {"v1": KEYWORDS_V1, "kw1": KEYWORDS_1, "kw2": KEYWORDS_2}
PILOT_DEFAULT_TIER = 3
UNKNOWN_TIER = "UNKNOWN"


def minimal_terms(terms: list[str]) -> list[str]:
    """The terms that hold no other term; a text contains one of these if and only if it contains any."""
    return [t for t in dict.fromkeys(terms) if not any(o in t for o in terms if o != t)]

"""Word lists and lookup tables whose content decides results."""

# Needles that decide the owner of a name before its path does.
ORGANIZATION_EXCEPTIONS = (
    ("evo2_", "arcinstitute"),
    ("evo-2", "arcinstitute"),
    ("evo-1", "arcinstitute"),
    ("evo-1.5", "arcinstitute"),
)

# Name needles to family labels, first match wins.
FAMILY_RULES = (
    ("agro-nucleotide-transformer", "AgroNT"),
    ("dnabert-s", "DNABERT-S"),
    ("dnabert-2", "DNABERT-2"),
    ("dnabert2", "DNABERT-2"),
    ("dna_bert", "DNABERT"),
    ("dnabert", "DNABERT"),
    ("ntv3", "NTv3"),
    ("nucleotide-transformer-v2", "NTv2"),
    ("nucleotide-transformer", "NT"),
    ("gena-lm", "GENA-LM"),
    ("moderngena", "ModernGENA"),
    ("grover", "GROVER"),
    ("hyenadna", "HyenaDNA"),
    ("plantcad", "PlantCaduceus"),
    ("caduceus", "Caduceus"),
    ("plantbimoe", "PlantBiMoE"),
    ("evo2", "Evo2"),
    ("evo-2", "Evo2"),
    ("evo-1", "Evo1"),
    ("evo-1.5", "Evo1"),
    ("megadna", "MegaDNA"),
    ("generator-v2", "GENERator"),
    ("generator", "GENERator"),
    ("generanno", "GENERanno"),
    ("carbon", "Carbon"),
    ("plasmidgpt", "PlasmidGPT"),
    ("genomeocean", "GenomeOcean"),
    ("genos", "Genos"),
    ("onegenome", "OneGenome"),
    ("aido", "AIDO.DNA"),
    ("hybridna", "HybriDNA"),
    ("botanic", "Botanic0"),
    ("mistral-dna", "Mistral-DNA"),
    ("modernbert-dna", "ModernBERT-DNA"),
    ("jamba-dna", "Jamba-DNA"),
    ("genslm", "GenSLM"),
)

# Name needles to branch, first match wins.
BRANCH_RULES = (
    ("annotator", "supervised_or_annotation"),
    ("artificial-detector", "supervised_or_annotation"),
    ("dnabert", "mlm_or_encoder"),
    ("dna_bert", "mlm_or_encoder"),
    ("nucleotide-transformer", "mlm_or_encoder"),
    ("ntv3", "mlm_or_encoder"),
    ("gena-lm", "mlm_or_encoder"),
    ("moderngena", "mlm_or_encoder"),
    ("grover", "mlm_or_encoder"),
    ("caduceus", "mlm_or_encoder"),
    ("plantcad", "mlm_or_encoder"),
    ("plantbimoe", "mlm_or_encoder"),
    ("aido.dna", "mlm_or_encoder"),
    ("modernbert-dna", "mlm_or_encoder"),
    ("botanic", "mlm_or_encoder"),
    ("generanno", "mlm_or_encoder"),
    ("d3lm", "mlm_or_encoder"),
    ("mutbert", "mlm_or_encoder"),
    ("hyenadna", "ar_or_generative"),
    ("evo", "ar_or_generative"),
    ("megadna", "ar_or_generative"),
    ("plasmidgpt", "ar_or_generative"),
    ("generator", "ar_or_generative"),
    ("carbon", "ar_or_generative"),
    ("genomeocean", "ar_or_generative"),
    ("genos", "ar_or_generative"),
    ("onegenome", "ar_or_generative"),
    ("mistral-dna", "ar_or_generative"),
    ("jamba-dna", "ar_or_generative"),
    ("hybridna", "ar_or_generative"),
    ("genslm", "ar_or_generative"),
)

# Branch to training paradigm and to scoring protocol.
PARADIGM_BY_BRANCH = {
    "ar_or_generative": "ntp",
    "mlm_or_encoder": "mlm",
    "supervised_or_annotation": "supervised",
    "manual_unknown": "unknown",
}
PROTOCOL_BY_BRANCH = {
    "ar_or_generative": "ar_likelihood_candidate",
    "mlm_or_encoder": "mlm_pll_candidate",
    "supervised_or_annotation": "unsupported_supervised_head",
    "manual_unknown": "manual_unknown",
}

# Name needles to architecture, first match wins.
ARCHITECTURE_RULES = (
    ("ntv3", "unet_transformer"),
    ("megadna", "transformer_decoder"),
    ("plasmidgpt", "transformer_decoder"),
    ("plantbimoe", "bimamba_moe"),
    ("plantcad", "bimamba"),
    ("caduceus", "bimamba"),
    ("modernbert-dna", "modernbert_encoder"),
    ("moderngena", "modernbert_encoder"),
    ("hybridna", "mamba_hybrid"),
    ("jamba-dna", "mamba_hybrid"),
    ("hyenadna", "hyena"),
    ("evo", "striped_hyena"),
    ("dnabert-2", "transformer_encoder_bpe"),
    ("dnabert2", "transformer_encoder_bpe"),
    ("dnabert-s", "transformer_encoder"),
    ("dna_bert", "transformer_encoder"),
    ("dnabert", "transformer_encoder"),
    ("agro-nucleotide-transformer", "transformer_encoder"),
    ("nucleotide-transformer", "transformer_encoder"),
    ("gena-lm", "transformer_encoder_bpe"),
    ("grover", "transformer_encoder_bpe"),
    ("aido", "transformer_encoder"),
    ("d3lm", "discrete_diffusion_esm_encoder"),
    ("mutbert", "rope_bert_encoder"),
    ("mistral-dna", "transformer_decoder"),
    ("genslm", "transformer_decoder"),
    ("genomeocean", "transformer_decoder"),
    ("genos", "transformer_decoder"),
    ("generator", "transformer_decoder"),
    ("generanno", "transformer_decoder"),
    ("botanic", "transformer_encoder"),
    ("onegenome", "transformer_decoder"),
)

# Config type or class needles to architecture, first match wins.
MODEL_TYPE_RULES = (
    ("striped_hyena", "striped_hyena"),
    ("stripedhyena", "striped_hyena"),
    ("hyena", "hyena"),
    ("bimamba", "bimamba"),
    ("mamba", "mamba"),
    ("jamba", "mamba_hybrid"),
    ("modernbert", "modernbert_encoder"),
    ("bert", "transformer_encoder"),
    ("roberta", "transformer_encoder"),
    ("electra", "transformer_encoder"),
    ("gpt_neox", "transformer_decoder"),
    ("gpt2", "transformer_decoder"),
    ("gptj", "transformer_decoder"),
    ("llama", "transformer_decoder"),
    ("mistral", "transformer_decoder"),
    ("mixtral", "transformer_decoder_moe"),
    ("qwen", "transformer_decoder"),
)

# Name needles to tokenizer kind, first match wins.
TOKENIZER_RULES = (
    ("3mer", "non_overlapping_3mer_or_codon"),
    ("codon", "non_overlapping_3mer_or_codon"),
    ("genslm", "non_overlapping_3mer_or_codon"),
    ("generanno", "single_nucleotide_or_byte"),
    ("agro-nucleotide-transformer", "non_overlapping_6mer"),
    ("generator", "non_overlapping_6mer"),
    ("huggingfacebio/carbon", "non_overlapping_6mer"),
    ("botanic", "non_overlapping_6mer"),
    ("d3lm", "non_overlapping_6mer"),
    ("nucleotide-transformer", "non_overlapping_6mer_like"),
    ("ntv3", "single_nucleotide_or_byte"),
    ("hyenadna", "single_nucleotide_or_byte"),
    ("caduceus", "single_nucleotide_or_byte"),
    ("plantcad", "single_nucleotide_or_byte"),
    ("plantbimoe", "single_nucleotide_or_byte"),
    ("evo", "single_nucleotide_or_byte"),
    ("megadna", "single_nucleotide_or_byte"),
    ("aido.dna", "single_nucleotide_or_byte"),
    ("hybridna", "single_nucleotide_or_byte"),
    ("mutbert", "single_nucleotide_or_byte"),
    ("gena", "bpe_or_wordpiece"),
    ("grover", "bpe_or_wordpiece"),
    ("plasmidgpt", "bpe_or_wordpiece"),
    ("mistral-dna", "bpe_or_wordpiece"),
    ("modernbert-dna", "bpe_or_wordpiece"),
    ("dnabert-2", "bpe_or_wordpiece"),
    ("dnabert2", "bpe_or_wordpiece"),
    ("genomeocean", "bpe_or_wordpiece"),
)

# Letters per token of families whose ratio is known.
LETTERS_PER_TOKEN = (
    ("GENA-LM", 9000.0 / 1024.0),
    ("ModernGENA", 9000.0 / 1024.0),
    ("GROVER", 4.0),
    ("Mistral-DNA", 4.0),
    ("ModernBERT-DNA", 4.0),
    ("GenomeOcean", 5.0),
    ("DNABERT-2", 4.0),
    ("DNABERT-S", 4.0),
    ("PlasmidGPT", 5.0),
)

# Context-length shorthands in names.
CONTEXT_MARKERS = ("seqlen", "context", "evo", "kb", "kbp")
CONTEXT_TOKENS = (
    ("262k", 262_144),
    ("131k", 131_072),
    ("65k", 65_536),
    ("32k", 32_768),
    ("16k", 16_384),
    ("8k", 8_192),
    ("4k", 4_096),
    ("2k", 2_048),
    ("1k", 1_024),
    ("1m", 1_048_576),
    ("450k", 450_000),
    ("160k", 160_000),
)
CONTEXT_PATTERNS = (
    (r"seqlen-(\d+)k", 1_000),
    (r"seqlen-(\d+)m", 1_000_000),
    (r"(\d+)k-seqlen", 1_000),
    (r"(\d+)m-seqlen", 1_000_000),
)
CONTEXT_KEYS = (
    "max_position_embeddings",
    "n_positions",
    "max_seq_len",
    "max_sequence_length",
    "max_seq_length",
    "seq_length",
    "sequence_length",
    "model_max_length",
    "max_seqlen",
    "max_context_length",
)

# Context keys that come before the others of a config, in this order.
CONTEXT_PRIORITY = (
    "max_position_embeddings",
    "n_positions",
    "max_seq_len",
    "max_sequence_length",
    "max_seq_length",
    "seq_length",
)

# Needles in a config's model type to tokenizer kind, first match wins.
TOKENIZER_BY_MODEL_TYPE = (
    ("bert", "wordpiece_or_bpe"),
    ("gpt", "bpe_or_byte"),
    ("llama", "bpe_or_byte"),
    ("mistral", "bpe_or_byte"),
    ("mixtral", "bpe_or_byte"),
    ("mamba", "bpe_or_byte"),
    ("jamba", "bpe_or_byte"),
)

# Config keys for the parameter estimate.
LAYER_KEYS = ("num_hidden_layers", "n_layer", "n_layers", "num_layers")
HIDDEN_KEYS = ("hidden_size", "d_model", "n_embd", "n_embed")

# Markers of mixed modality, size buckets and short family names.
MIXED_MODALITY_MARKERS = ("glm2", "lucaone")
PARAM_SCALE_RULES = (
    ("-v1-1m-", "small"),
    ("-v2-50m-", "small"),
    ("-v1-17m-", "medium"),
    ("-v2-100m-", "medium"),
    ("-v1-138m-", "large"),
    ("-v2-250m-", "large"),
)
FAMILY_SHORT_RULES = (
    ("mistral-dna", "Mistral-DNA"),
    ("nucleotide-transformer-v2", "NT-v2"),
    ("nucleotide-transformer", "NT"),
)

# Data files, split words and task words.
DATA_SUFFIX_PATTERN = r"(?i)\.(csv|tsv|fa|fasta|fna)(\.gz)?$"
SKIP_DIRS = ("ISM_Tables", "Figures", ".git", "__pycache__")
SPLIT_WORDS = ("train", "test", "dev", "val", "valid", "validation")
REGRESSION_WORDS = ("strength", "expression", "_exp", "polya", "rna_abundance")
SEQ_COLUMNS = ("sequence", "seq", "dna", "Sequence", "Seq", "DNA")
LABEL_COLUMNS = ("label", "class", "target", "y", "Label", "Class", "Target")

# Species prefixes of strata whose label encodes the species.
SPECIES_PREFIXES = (
    ("fungi_genome", "fungi_sp_"),
    ("virus_variants", "covid_var_"),
    ("virus_species", "virus_sp_"),
)

# Display orders.
ELEMENT_ORDER = (
    "promoter",
    "enhancer",
    "splice_donor",
    "splice_acceptor",
    "chromatin_access",
    "polyA",
    "lncRNA",
    "nascent_RNA",
    "splicing_plant_donor",
    "splicing_plant_acceptor",
    "yeast_genome",
    "fungi_genome",
    "virus_variants",
    "virus_species",
)
# How many of these belong to each category, one after the other.
CATEGORY_SIZES = (("Human", 4), ("Plant", 6), ("Fungi", 2), ("Virus", 2))

# Sizes of models whose name gives a preset instead of a number.
SIZE_PRESETS = (
    ("hyenadna-tiny", 1_700_000),
    ("hyenadna-small", 6_600_000),
    ("hyenadna-medium", 13_200_000),
    ("hyenadna-large", 53_000_000),
)

# Control-table motifs, length tiers and GC levels.
MOTIFS = ("TATAAAA", "CACGTG", "CCAAT", "GGGCGG", "CCCTC")
LENGTH_TIERS = (200, 300, 500, 1000)
GC_LEVELS = (0.20, 0.30, 0.40, 0.50, 0.60, 0.70, 0.80)
